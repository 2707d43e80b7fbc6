"""Every operator and job as a query over the test tables, and the SQL that checks it."""
