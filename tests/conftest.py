import pytest

from tests.comparing import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def workspace(spark):
    from claimsieve.staging import Workspace

    space = Workspace(spark)
    yield space
    space.drop()


@pytest.fixture
def plan_text():
    def text(df):
        return df._jdf.queryExecution().explainString(
            df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
        )

    return text
