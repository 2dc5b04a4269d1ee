"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import let, whole
from evidara.session import durable

BLOCK_BYTES = 4096
#: Low bits of a name that hold a block's rank within its bucket.
RANK_BITS = 8
#: Groups with more than one row in so many are joined apart; there are fewer of them than this.
LARGE_GROUPS = 1000


def _bucket(value: Column) -> Column:
    """The bucket of a block or pair: its hash without the bits kept for the rank."""
    return F.xxhash64(value).bitwiseAND(F.lit(-1 << RANK_BITS))


def _crowded(units: DataFrame) -> DataFrame:
    """Of (bucket, unit) rows: the buckets that hold several different units, with these sorted.

    The set is gathered before and after the shuffle, so a unit that fills a third of the table arrives once from each task.
    """
    sets = units.groupBy("bucket").agg(F.collect_set("unit").alias("units"))
    return sets.where(F.size("units") > 1).select("bucket", F.array_sort("units").alias("units"))


def _rank(crowd: DataFrame) -> DataFrame:
    """Each unit of a crowded bucket with its rank; more units than a name has room for are an error."""
    ranked = crowd.select("bucket", F.posexplode("units").alias("rank", "unit"))
    fits = F.when(F.col("rank") < (1 << RANK_BITS), F.col("rank").cast("long"))
    return ranked.withColumn("rank", F.coalesce(fits, F.raise_error(F.lit("a bucket holds too many different blocks")).cast("long")))


def _named(rows: DataFrame, units: Column, spent: str) -> DataFrame:
    """rows with ``names``, one for each of their units, and their number ``n``; the column ``spent`` goes. Checkpointed.

    The names of a level are written before the next level reads them, so that no plan holds two levels.
    """
    kept = [c for c in rows.columns if c not in (spent, "names", "n")]
    crowd = durable(_crowded(rows.select(F.explode(units).alias("unit")).select(_bucket(F.col("unit")).alias("bucket"), "unit")))
    if crowd.isEmpty():
        return durable(rows.select(*kept, F.transform(units, _bucket).alias("names")).select("*", F.size("names").alias("n")))
    # rare: some units are told apart by their rank; each unit is looked up, in rows that keep their numbers
    rows = durable(rows)
    each = rows.select("row", F.posexplode(units).alias("at", "unit")).withColumn("bucket", _bucket(F.col("unit")))
    found = each.join(_rank(crowd), ["bucket", "unit"], "left").select("row", "at", (F.col("bucket") + F.coalesce("rank", F.lit(0))).alias("name"))
    names = found.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
    return durable(rows.select(*kept).join(names, "row").select("*", F.size("names").alias("n")))


def _blocks(text: Column, block_bytes: int) -> Column:
    def cut(raw: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / block_bytes)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))

    return let(text.cast("binary"), cut)


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One identity (level, name) for each document, equal exactly where the texts are equal.

    Texts are cut into blocks of ``block_bytes``. Different blocks are sorted into buckets and each gets an integer
    name: the bucket's number plus the block's rank among the sorted different blocks of that bucket. Two different
    blocks thus never share a name. Then adjacent names are paired, the different pairs get names in the same way, and
    so on until one name is left; a document of 2**k blocks takes k rounds, and finished documents leave the rounds.
    Documents of different length may share a name only at different levels: a last name without a partner is paired with null.

    The text crosses the network once, as different blocks; afterwards rows carry only names. Each level is checkpointed,
    so the plan of a level is the same however long the texts are. Returns (row, doc_id, text_sha256, level, name), where
    row tells repeated rows apart.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    hashed = source.select("row", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text")
    names, level, done = _named(hashed, _blocks(F.col("text"), block_bytes), "text"), 0, None
    while True:
        ended = names.where("n = 1").select("row", "doc_id", "text_sha256", F.lit(level).alias("level"), F.get("names", F.lit(0)).alias("name"))
        done = ended if done is None else done.unionByName(ended)
        rest = names.where("n > 1")
        if rest.isEmpty():
            return done
        level += 1
        pair = lambda i: F.struct(F.get("names", 2 * i).alias("left"), F.get("names", 2 * i + 1).alias("right"))
        names = _named(rest, F.transform(F.sequence(F.lit(0), ((F.col("n") + 1) / 2).cast("int") - 1), pair), "names")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document with the id that stays of its group of equal texts, the group's size, and whether it stays.

    Of equal texts the row with the largest id stays (null ids are the smallest); of rows that repeat an id within the
    group, one. Null texts count as empty, and the empty text is a group like any other. Extra columns, whatever their
    names, are left out; an empty table gives no rows. Texts of many megabytes take a level more for each doubling.

    Groups with more than one row in LARGE_GROUPS go to all tasks, as there are fewer than LARGE_GROUPS of them; so a
    group with a third of all rows is not gathered in one task.
    """
    named = name_documents(docs, id_col, text_col, block_bytes)
    best = durable(named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")))
    rows = best.agg(F.sum("group_size")).first()[0] or 0
    is_large = F.col("group_size") * LARGE_GROUPS > rows
    large, small = F.broadcast(best.where(is_large)), best.where(~is_large)
    joined = named.join(large, ["level", "name"]).unionByName(named.join(large.select("level", "name"), ["level", "name"], "left_anti").join(small, ["level", "name"]))
    return joined.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"
    )


def unused(columns: list[str], wish: str) -> str:
    """A column name like the wish that none of the columns has, in any case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of docs one row for each (doc_id, text_sha256) of ``kept``, with all columns of docs, whatever their names.

    Rows are dealt once by id and hash of the text; both the choice among repeated rows and the join use that.
    """
    key, number = unused(docs.columns, "keep_key"), unused(docs.columns, "keep_number")
    named = lambda id_, sha: F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("-")), sha)
    keyed = docs.withColumn(key, named(F.col(id_col), F.sha2(whole(text_col).cast("binary"), 256)))
    first = Window.partitionBy(key).orderBy(F.lit(0))
    single = keyed.withColumn(number, F.row_number().over(first)).where(F.col(number) == 1)
    wanted = kept.select(named(F.col("doc_id"), F.col("text_sha256")).alias(key))
    return single.join(wanted, key, "left_semi").select(*docs.columns)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Null texts count as empty; a row without id stays only where no row of its text has one; of rows that repeat id and
    text one stays. Extra columns stay, whatever their names; an empty table stays empty.
    """
    return keep_rows(docs, exact_duplicates(docs, id_col, text_col).where("kept"), id_col, text_col)
