"""Queries against their SQL twins on rows that the smallest tables don't hold."""

import hashlib
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from evidara.functions import contacts
from evidara.plans import catalogue
from evidara.session import durable


@pytest.fixture
def both(spark, tmp_path):
    """A query's rows and its twin's over one made-up table."""

    def compare(name, table, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        connection = duckdb.connect()
        connection.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        wanted = connection.sql(catalogue.ORACLES[name])
        found = catalogue.QUERIES[name](spark, str(tmp_path)).select(*wanted.columns)
        return sorted(map(tuple, found.collect())), sorted(wanted.fetchall())

    return compare


def test_robots_exception_of_ended_pages(both):
    host = next(h for h in (f"h{i}.example" for i in range(99)) if "4" <= hashlib.md5(h.encode()).hexdigest()[0] < "8")
    paths = ("/en/41.html", "/en/41", "/en/5.html", "/en/5", "/fr/41.html", "/fr/41.html?x", "/en/41.html?x", "")
    ours, theirs = both("robots_gate", "pages", "page_id long, url string", [(i, f"https://{host}{p}") for i, p in enumerate(paths)])
    assert ours == theirs and [r[2] for r in ours] == [True, True, False, False, False, True, True, True]


def test_paragraphs_with_open_references(both):
    pages = ["<title>a &amp;&amp</title><p>x &amp; y &quot", "<p>&lt;&gt &copy; &middot b &amp;lt; &a &", "<p>AT&T &notit &copy</p>", "", "<p> </p>"]
    ours, theirs = both("page_paragraphs", "pages", "page_id long, html string", list(enumerate(pages)))
    assert ours == theirs and ours[0][2] == len("a &&amp \n\n x & y &quot")


def test_surroundings_after_other_white_space(both):
    word = "Ensch. "
    texts = ["Zu und. Dieüauß der.\n" + word * 14 + "then", "x" * 38 + ". " + "One\nTwo Three " * 9, ("One Two  Three " * 9) + "end", "short", None]
    ours, theirs = both("quote_surroundings", "documents", "doc_id long, text string", list(enumerate(texts)))
    assert ours == theirs and ours[0][1] > texts[0].index("\n")


def test_addresses_with_odd_ends(both):
    ends = ["", ".", "7", "é", "-", "_x", "..org", ".c", ".9a", ",", "@b.org", ".com.", "-.x", ".é.de"]
    texts = [f"write ann.{i}@mail4.example.com{end} now" for i, end in enumerate(ends)]
    texts += ["cut off at bob@mail4.example.c", "at bob@mail4.e", "-eve@a.org, .+eve2@a.org", "@me@social.org and a@b@c.org", "me@pic.png or you@example.com", "a@.org b@ @ @c", "two x@a.org;X@A.org", None]
    ours, theirs = both("document_emails", "documents", "doc_id long, text string", list(enumerate(texts)))
    assert ours == theirs and len(ours) == len(texts) - 3


def test_checkpoints_leave_no_shuffle_files(spark):
    def files():
        return sum(1 for _ in Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*.data"))

    summed = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    before = files()
    kept = durable(summed)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and kept.count() == 7


def test_channels_read_the_links_once(spark):
    plan = spark.createDataFrame([("x",)], "h string").select(contacts.channels(F.col("h")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("(?i)<a\\b") == 1
