"""Contacts of whole sites: what several pages say of one organisation, brought together and written into its record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import contacts
from evidara.functions.text import let
from evidara.session import durable

#: A site's limits travel to its pages in so many copies, so that pages of one site are dealt out.
SPREAD = 16
CHANNEL = "struct<type:string,url:string,label:string,note:string>"
BLOCK = f"struct<email:string,phone:string,form:string,channels:array<{CHANNEL}>,source:string,checked:string>"


def page_contacts(pages: DataFrame, site: str, turn: str, text: Column) -> DataFrame:
    """(site, turn, url, tier, emails, phone, form, channels) of each page, from url, html and the visible text."""
    page = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col(site).alias("site"), F.col(turn).alias("turn"), "url", contacts.page_tier(F.col("url")).alias("tier"), contacts.emails(page, F.coalesce(text, F.lit(""))).alias("emails"),
        contacts.best_phone(contacts.phones(page, F.coalesce(text, F.lit("")))).alias("phone"), contacts.has_contact_form(F.col("url"), page).alias("form"), contacts.channels(page).alias("channels"),
    )


def _visited(found: DataFrame) -> DataFrame:
    """The pages up to the one after which a visitor has all there is to find and stops."""
    sought = [
        F.min(F.when((F.col("tier") == 0) & (F.size("emails") > 0), F.col("turn"))), F.min(F.when(F.col("phone.confidence") == "high", F.col("turn"))), F.min(F.when(F.col("form"), F.col("turn"))),
        *(F.min(F.when(F.col("channels")[kind].isNotNull(), F.col("turn"))) for kind in contacts.CHANNELS),
    ]
    firsts = found.groupBy("site").agg(F.array(*sought).alias("firsts")).where(~F.exists("firsts", lambda at: at.isNull()))
    ends = firsts.select("site", F.array_max("firsts").alias("last"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    dealt = found.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(SPREAD)).cast("int"))
    return dealt.join(ends, ["site", "part"], "left").where("last is null or turn <= last").drop("part", "last")


def site_contacts(found: DataFrame) -> DataFrame:
    """One row a site: email, email_source, phone, phone_confidence, phone_source, form, channels (kind -> url), from ``page_contacts``.

    Pages count in order of their turns, up to the first at which a contact page's address, a linked number, a form and
    a channel of every kind are known. The address is one of the best tier of pages, a shared mailbox before others, then the one
    seen first; its source is the first page of that tier with it. The number is the last page's that links one, else
    the first found. Form and channels are those of the first page that has them. Sites without any finding have nulls
    and an empty map. All choices are minima and maxima, so a site's pages are summed up wherever they lie. Turns should
    be distinct within a site; of equal ones the smaller URL counts as first.
    """
    kept = _visited(durable(found))
    spots = kept.select("site", "turn", "url", "tier", F.posexplode("emails").alias("place", "address"))
    seen = F.struct("turn", "url", "place")
    addresses = spots.groupBy("site", F.lower("address").alias("key")).agg(F.min(seen).alias("seen"), F.min(F.struct("tier", "turn", "url", "place", "address")).alias("best"))
    choice = F.struct(F.col("best.tier"), (~contacts.is_shared_mailbox(F.col("best.address"))).alias("own"), "seen", F.col("best.address"), F.col("best.url"))
    mail = addresses.groupBy("site").agg(F.min(choice).alias("mail"))
    at = F.struct("turn", "url")
    phone = F.struct(F.col("phone.number"), F.col("phone.confidence"), "url")
    linked, any_ = F.max_by(phone, F.when(F.col("phone.confidence") == "high", at)), F.min_by(phone, F.when(F.col("phone").isNotNull(), at))
    first = [F.min_by(F.col("channels")[kind], F.when(F.col("channels")[kind].isNotNull(), at)).alias(kind) for kind in contacts.CHANNELS]
    rest = kept.groupBy("site").agg(F.coalesce(linked, any_).alias("phone"), F.min_by("url", F.when(F.col("form"), at)).alias("form"), *first)
    known = F.filter(F.array(*(F.struct(F.lit(kind).alias("key"), F.col(kind).alias("value")) for kind in contacts.CHANNELS)), lambda e: e["value"].isNotNull())
    return rest.join(mail, "site", "left").select(
        "site", F.col("mail.address").alias("email"), F.col("mail.url").alias("email_source"), F.col("phone.number").alias("phone"), F.col("phone.confidence").alias("phone_confidence"),
        F.col("phone.url").alias("phone_source"), "form", F.map_from_entries(known).alias("channels"),
    )


def filled(old: Column, new: Column, force: bool) -> Column:
    """The new value where there is one and the old one is empty or force is given, else the old one."""
    told = F.coalesce(new, F.lit("")) != ""
    return F.when(told & (F.lit(force) | (F.coalesce(old, F.lit("")) == "")), new).otherwise(old)


def merged_channels(old: Column, found: Column, force: bool) -> Column:
    """The old channels in their order, then those of new kinds; with force old ones take the found address, labels and notes stay."""
    had = F.coalesce(old, F.array().cast(f"array<{CHANNEL}>"))
    kinds = F.transform(had, lambda c: c["type"])
    told = F.coalesce(found, F.create_map().cast("map<string,string>"))

    def renewed(channel: Column, at: Column) -> Column:
        first = F.array_position(kinds, channel["type"]) == at + 1
        return channel.withField("url", F.when(first, F.coalesce(told[channel["type"]], channel["url"])).otherwise(channel["url"])) if force else channel

    more = F.transform(F.filter(F.map_entries(told), lambda e: ~F.array_contains(kinds, e["key"])), lambda e: F.struct(e["key"].alias("type"), e["value"].alias("url"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("note")))
    return F.concat(F.transform(had, renewed), more)


def merged_block(old: Column, found: Column, source: Column, day: Column, force: bool = False) -> Column:
    """The contact block (BLOCK) that a record should have after a look at its pages; null where nothing changes.

    ``found`` is a struct of email, phone, form and channels (a map). Without force only what is empty is filled in.
    """
    channels = merged_channels(old["channels"], found["channels"], force)
    values = F.struct(*(filled(old[name], found[name], force).alias(name) for name in ("email", "phone", "form")), channels.alias("channels"))
    same = lambda new: F.forall(F.array(*(new[name].eqNullSafe(old[name]) for name in ("email", "phone", "form"))), lambda equal: equal) & (new["channels"] == F.coalesce(old["channels"], F.array().cast(f"array<{CHANNEL}>")))
    return let(values, lambda new: F.when(~same(new), F.struct(new["email"].alias("email"), new["phone"].alias("phone"), new["form"].alias("form"), new["channels"].alias("channels"), F.coalesce(source, old["source"], F.lit("")).alias("source"), F.date_format(day, "yyyy-MM-dd").alias("checked"))))


def block_text(block: Column) -> Column:
    """A contact block as the lines of front matter, the last one ended too; null for null."""
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(name), value))
    channel = lambda c: F.concat_ws("\n", F.concat(F.lit("  - type: "), c["type"]), F.concat(F.lit("    url: "), c["url"]), line("    label: ", c["label"]), line("    note: ", c["note"]))
    listed = F.when(F.size(block["channels"]) > 0, F.concat(F.lit("  channels:\n"), F.array_join(F.transform(block["channels"], channel), "\n")))
    phone = F.when(F.coalesce(block["phone"], F.lit("")) != "", F.concat(F.lit('  phone: "'), block["phone"], F.lit('"')))
    lines = F.concat_ws("\n", F.lit("contact:"), line("  email: ", block["email"]), phone, line("  form: ", block["form"]), listed, F.concat(F.lit("  source: "), block["source"]), F.concat(F.lit("  checked: "), block["checked"]))
    return F.when(block.isNotNull(), F.concat(lines, F.lit("\n")))
