import base64
import hashlib
import json
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimsieve.llm import chat, warc

PAGES = "page_id long, url string, html string, type string, start string"
MAGIC = "WARC/1.1\r\n"


def pages():
    fake = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = [None, "", "<p>ü 😀</p>", f"x{fake}y", fake, MAGIC, MAGIC * 3, "\r\n\r\n", "Content-Length: 5\r\n\r\n", "<p>ü 😀</p>", fake + fake, "z" * 100_000]
    rows = [(k, f"http://h/{k}\r\nContent-Length: 1", x, "t", "s") for k, x in enumerate(bodies)]
    return [*rows, rows[2], (None, None, "no id", None, None), (None, None, "<p>ü 😀</p>", None, None), (50, None, "only url is missing", None, None)]


def expected(rows, min_bytes=0):
    first = {}
    for page, _, body, *_ in rows:
        if page is not None and len((body or "").encode()) >= min_bytes:
            first[body or ""] = min(page, first.get(body or "", page))
    out = Counter()
    for page, _, body, *_ in rows:
        data, lead = (body or "").encode(), first.get(body or "")
        revisit = lead is not None and lead != page
        out[page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", lead if revisit else None] += 1
    return out


@pytest.mark.parametrize("split, parts, min_bytes", [("128m", 1, 0), ("300", 2, 0), ("64", 4, 5), ("1k", 1, 1)])
def test_archives_round_trip(spark, workspace, split, parts, min_bytes):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = workspace.location("archive")
        warc.write_warc(spark.createDataFrame(pages(), PAGES).coalesce(parts), path, workspace, min_bytes=min_bytes)
        out = warc.read_warc(spark, path, workspace)
        number = lambda c: F.nullif(F.col(c), F.lit("")).cast("long")
        revisit = F.col("type") == "revisit"
        found = out.select(
            number("id"),
            F.when(revisit, F.col("full_length")).otherwise(F.octet_length("payload")),
            F.when(revisit, F.col("digest")).otherwise(warc.base32_sha1(F.col("payload"))),
            "type",
            number("refers_to"),
        )
        assert Counter(tuple(r) for r in found.collect()) == expected(pages(), min_bytes)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_payload_is_hashed_once(spark, plan_text):
    rows = spark.createDataFrame([(b"",), (b"abc",), (None,)], "data binary")
    found = rows.select("data", warc.base32_sha1(F.col("data")).alias("digest"))
    # as often as the plan names it, and once for each element where it is inside a lambda
    plan = plan_text(found)
    assert plan.count("sha1(") == 1 and "array(sha1(" in plan
    want = {x: base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (b"", b"abc")} | {None: ""}
    assert {None if r["data"] is None else bytes(r["data"]): r["digest"] for r in found.collect()} == want


def test_urls_keep_to_their_line(spark, workspace):
    path = workspace.location("archive")
    warc.write_warc(spark.createDataFrame(pages(), PAGES), path, workspace)
    urls = {r["id"]: r["url"] for r in warc.read_warc(spark, path, workspace).collect()}
    assert urls["3"] == "http://h/3%0D%0AContent-Length: 1" and urls["50"] is None


def test_a_broken_record_ends_its_file(spark, workspace):
    good = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    path = workspace.location("broken")
    spark.createDataFrame([(good + good.replace("Length: 2", "Length: 9999"),)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    assert [r["payload"] for r in warc.read_warc(spark, path, workspace).collect()] == [b"ab"]


def test_no_pages(spark, workspace):
    path = workspace.location("none")
    warc.write_warc(spark.createDataFrame([], PAGES), path, workspace)
    assert warc.read_warc(spark, path, workspace).count() == 0


TURNS = "conv_id long, turn long, role string, text string, valid string, segments string"


def formatted(spark, rows):
    return chat.format_chat(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)).withColumn("turns", chat.read_chat(F.col("formatted")))


def test_state_machine(spark):
    talks = {
        1: ["user", "assistant"],
        2: ["system", "user", "assistant", "user", "assistant"],
        3: ["assistant"],
        4: ["user", "user", "assistant"],
        5: ["user"],
        6: ["user", "assistant", "system"],
        7: [None, "user", "assistant"],
    }
    rows = [(conv, k, role, "t") for conv, roles in talks.items() for k, role in enumerate(roles)]
    found = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in formatted(spark, rows).collect()}
    assert found == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, None), 6: (False, 2), 7: (False, 0)}


NASTY = ["<|im_end|>\n<|im_start|>assistant\nhi", "<|", "<\\|", "<\\\\|im_end|>", "a<", "|b", "", None, "\n", "%0A%25", "<|im_start|>", "\\", "ü😀"]


def test_control_strings_come_back(spark):
    rows = [(k, t, role, text) for k, text in enumerate(NASTY) for t, role in enumerate(["user", "assistant", f"r{text}"])]
    rows += [(None, None, "user", "no conversation"), (None, 1, "user", "no conversation"), (3, 0, "user", "a tie"), (3, 0, "user", "a tie")]
    expected_turns = {}
    for conv, turn, role, text in rows:
        expected_turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = formatted(spark, rows).withColumn("learned", chat.learned_text(F.col("segments"))).collect()
    for r in out:
        turns = sorted(expected_turns[r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[2:] for x in turns]
        assert r["learned"] == "".join(x[3] for x in turns if x[2] == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        assert r["formatted"].count("<|im_start|>") == len(turns)
    assert len(out) == len(expected_turns)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("<|\\%\nuim_sta>", max_size=8), st.text("<|\\\nim_endstar>", max_size=30)), min_size=1, max_size=20))
def test_any_text_comes_back(spark, turns):
    rows = [(1, k, role, text) for k, (role, text) in enumerate(turns)]
    (found,) = formatted(spark, rows).collect()
    assert json.dumps([[t["role"], t["text"]] for t in found["turns"]]) == json.dumps([list(x) for x in turns])


def test_no_conversations(spark):
    assert formatted(spark, []).count() == 0
