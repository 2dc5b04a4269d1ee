"""The verification state: replay and stream against the rules written out, and restarts between batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidara.operators import evidence_history
from evidara.streaming.evidence_state import keep_evidence_state

ATTEMPTS = "url string, claim string, at timestamp, seq long, kind string, verdict boolean, forced boolean, error string, not_modified boolean, body string"
START = datetime(2026, 1, 1, 8)


def random_attempts(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url, claim = f"https://{rng.choice('abc')}.org/", rng.choice(["the quoted words", "other words ... at the end"])
        manual = rng.random() < 0.1
        body = rng.choice(["", "short", f"Here are the  quoted words, and {claim} again.", "the quoted words twice: the quoted words", "nothing of it stands on this long page", None])
        error = None if manual else rng.choice([None] * 5 + ["HTTP 403", "HTTP 429", "TIMEOUT", "HTTP 500"])
        rows.append((url, claim, START + timedelta(hours=3 * i), i, "manual" if manual else "check", rng.random() < 0.5 if manual else None, rng.choice([None, False, False, True]), error, rng.random() < 0.25, body))
    return rows


def by_the_rules(rows):
    """One entry a page, one rule after the other, as a person would do it."""
    pages, out = {}, {}
    for url, claim, at, seq, kind, verdict, forced, error, not_modified, body in sorted(rows, key=lambda r: (r[2], r[3])):
        p = pages.setdefault(url, {"blocked": None, "since": None, "checked": None, "verified": {}, "manual": {}})
        if kind == "manual":
            p["manual"][claim] = verdict
            continue
        good = lambda v: "GOOD" if v else "BAD"
        text, hand = " ".join((body or "").split()), p["manual"].get(claim)
        seen = None if forced else hand
        unchanged = ambiguous = queued = False
        if p["blocked"] and not forced:
            status, unchanged, queued = p["blocked"] if seen is None else good(seen), True, seen is None
        elif error:
            status = error
            if error in ("HTTP 403", "HTTP 429", "ROBOTS_BLOCKED"):
                p["since"] = p["since"] if p["blocked"] else at.date()
                p["blocked"], queued = error, hand is None
        elif not_modified and not forced and claim in p["verified"]:
            status, unchanged, p["checked"] = good(p["verified"][claim]), True, at.date()
        elif len(body or "") < len(claim):
            status = good(seen) if seen is not None else "PAGE_TOO_SHORT" if body else "EMPTY_RESPONSE"
            unchanged, queued = seen is not None, seen is None
        else:
            head, _, tail = claim.partition(" ... ")
            holds = claim in text if not tail else head in text and tail in text[text.index(head) + len(head) :]
            status, ambiguous = good(holds), holds and not tail and text.count(claim) > 1
            p["verified"][claim] = holds
            p["blocked"] = p["since"] = None
            p["checked"] = at.date()
        out[seq] = (url, claim, status, unchanged, ambiguous, queued, p["blocked"], p["since"] if p["blocked"] else None, p["checked"])
    return out


def outcomes(rows):
    return {r["seq"]: (r["url"], r["claim"], r["status"], r["unchanged"], r["ambiguous"], r["queued"], r["blocked"], r["blocked_since"], r["checked"]) for r in rows if r["status"] != "DUE"}


def test_replay_follows_the_rules(spark):
    rows = random_attempts(1, 400)
    facts = evidence_history.attempt_facts(spark.createDataFrame(rows, ATTEMPTS).repartition(4))
    got = outcomes(evidence_history.replay(facts).collect())
    assert got == by_the_rules(rows)
    assert {"GOOD", "BAD", "HTTP 403", "TIMEOUT", "EMPTY_RESPONSE", "PAGE_TOO_SHORT"} <= {v[2] for v in got.values()}
    assert evidence_history.replay(facts.limit(0)).count() == 0


@pytest.fixture
def rocksdb(spark):
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def run_batches(spark, tmp_path, batches):
    """Each batch in a query of its own, stopped after it and started again for the next."""
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    for batch in batches:
        evidence_history.attempt_facts(spark.createDataFrame(batch, ATTEMPTS)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(evidence_history.FACTS).parquet(source)
        query = keep_evidence_state(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    return spark.read.parquet(out).collect()


def test_stream_killed_between_batches_equals_replay(spark, tmp_path, rocksdb):
    rows = random_attempts(2, 120)
    got = run_batches(spark, tmp_path, [rows[:50], rows[50:51], rows[51:]])
    assert outcomes(got) == by_the_rules(rows)


def test_block_then_timeout_then_success_and_due_checks(spark, tmp_path, rocksdb):
    page = lambda day, seq, **of: ("https://a.org/", "the quoted words", START + timedelta(days=day), seq, "check", None, of.get("forced", False), of.get("error"), False, of.get("body"))
    batches = [
        [page(0, 0, body="Here the quoted words stand."), page(1, 1, error="HTTP 403")],
        [page(2, 2, error="TIMEOUT", forced=True), page(2, 3, body="never read")],
        [page(3, 4, forced=True, body="Here the quoted words stand.")],
        [page(30, 5, forced=True, error="TIMEOUT")],
        [page(31, 6, body="Here the quoted words stand.")],
    ]
    rows = run_batches(spark, tmp_path, batches)
    got = outcomes(rows)
    assert [got[i][2] for i in range(7)] == ["GOOD", "HTTP 403", "TIMEOUT", "HTTP 403", "GOOD", "TIMEOUT", "GOOD"]
    assert [str(got[i][7]) for i in range(5)] == ["None", "2026-01-02", "2026-01-02", "2026-01-02", "None"]
    assert [str(got[i][8]) for i in (1, 2, 3, 4)] == ["2026-01-01"] * 3 + ["2026-01-04"]
    due = [r for r in rows if r["status"] == "DUE"]
    assert [str(r["at"]) for r in due] == ["2026-01-11 08:00:00"] and due[0]["url"] == "https://a.org/"


def test_facts_of_nulls(spark):
    rows = [("u", None, START, 0, "check", None, None, None, None, None), ("u", "", START, 1, "check", None, None, None, None, "x"), (None, "a", START, 2, "check", None, None, None, None, "a a")]
    facts = evidence_history.attempt_facts(spark.createDataFrame(rows, ATTEMPTS))
    got = {r["seq"]: r["status"] for r in evidence_history.replay(facts).collect()}
    assert got[1] == "BAD" and got[2] == "GOOD"
    assert facts.where(F.col("forced").isNull()).count() == 0
