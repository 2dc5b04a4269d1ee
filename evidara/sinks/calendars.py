"""Calendar files, one for each group of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.dates import strict_time
from evidara.session import shuffle_partitions
from evidara.sinks.exports import ics_escape, ics_fold


def _clock(minutes: Column) -> Column:
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit("00"))


def event_lines(domain: str, stamp: str) -> Column:
    """The lines of an event from the columns org, title, date, end_date, time, end_time, url.

    A time of the form H:MM gives a start at that time of day in no zone, and an end by end_time, else by end_date; without
    one the event lasts whole days. Ends of days are exclusive. The identity depends on organisation, day and title.
    """
    day = lambda c: F.date_format(c, "yyyyMMdd")
    start, end = strict_time(F.col("time")), strict_time(F.col("end_time"))
    last_day = F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add("end_date", 1)))
    uid = F.left(F.sha2(F.concat_ws("\u0000", F.col("org"), day(F.col("date")), F.col("title")), 256), F.lit(32))
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid, F.lit(f"@{domain}")), F.lit(f"DTSTAMP:{stamp}"),
        F.when(start.isNull(), F.concat(F.lit("DTSTART;VALUE=DATE:"), day(F.col("date")))).otherwise(F.concat(F.lit("DTSTART:"), day(F.col("date")), F.lit("T"), _clock(start))),
        F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("DTEND:"), day(F.col("date")), F.lit("T"), _clock(end))).otherwise(last_day),
        F.concat(F.lit("SUMMARY:"), ics_escape(F.concat_ws(": ", "org", "title"))), F.concat(F.lit("CATEGORIES:"), ics_escape(F.col("org"))),
        F.when(F.length("url") > 0, F.concat(F.lit("URL:"), ics_escape(F.col("url")))), F.lit("END:VEVENT"),
    )
    return F.transform(F.array_compact(lines), lambda line: ics_fold(line))


def calendar_lines(events: DataFrame, group: str, name: Column, domain: str, stamp: str) -> DataFrame:
    """(group, part, date, uid, value): each event's lines, and the head and foot of each group's calendar.

    part is 0 for heads, 1 for events, 2 for feet. Events without group or date are left out; equal events stay.
    name is the calendar's title, an expression of the group.
    """
    joined = lambda lines: F.array_join(lines, "\r\n")
    known = events.where(F.col(group).isNotNull() & (F.col(group) != "") & F.col("date").isNotNull())
    bodies = known.select(F.col(group), F.lit(1).alias("part"), "date", event_lines(domain, stamp).alias("lines")).select(group, "part", "date", F.get("lines", F.lit(1)).alias("uid"), joined(F.col("lines")).alias("value"))
    head = F.transform(F.array(F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit(f"PRODID:-//{domain}//Calendar//EN"), F.concat(F.lit("X-WR-CALNAME:"), ics_escape(name)), F.lit("CALSCALE:GREGORIAN")), lambda line: ics_fold(line))
    nothing = (F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("uid"))
    ends = known.select(group).distinct().select(group, F.explode(F.array(F.struct(F.lit(0).alias("part"), joined(head).alias("value")), F.struct(F.lit(2).alias("part"), F.lit("END:VCALENDAR").alias("value")))).alias("end"))
    return bodies.unionByName(ends.select(group, "end.part", *nothing, "end.value"))


def write_calendars(events: DataFrame, folder: str, group: str, name: Column, domain: str, stamp: str) -> None:
    """One calendar file in a folder for each group, its events by date, then by identity.

    A group is written by one task, since a file has one order; it streams lines from a sort that may spill, so memory stays
    bounded. Groups are spread over all tasks; their number is stated, so adaptive execution merges and splits none.
    """
    spark = events.sparkSession
    lines = calendar_lines(events, group, name, domain, stamp)
    sorted_lines = lines.repartition(shuffle_partitions(spark), group).sortWithinPartitions(group, "part", "date", "uid", "value")
    sorted_lines.select(group, "value").write.mode("overwrite").partitionBy(group).option("lineSep", "\r\n").text(folder)
