"""Titles of events in a language that readers of the calendar may not read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidara.functions.text import cjk_share

# fixed values: recurring titles with their variable parts, and what they mean
RECURRING = (
    ("公民科技跑咖松_(.+)", "Civic Tech Hackathon — $1"),
    ("第(.+?)次(.+?)松", "$1th $2 Hackathon"),
    ("公民科技(.+)活動", "Civic Tech $1 Activity"),
)
MOSTLY = 0.3


def english_title(title: Column, organisation: Column) -> Column:
    """A translation of a title mostly in Han characters: of the first recurring one it begins with, else "<organisation> event".

    Null for any other title; what follows a recurring title is left out.
    """
    known = [F.when(title.rlike("^" + shape), F.regexp_replace(title, f"(?s)^(?-s:{shape}).*", words)) for shape, words in RECURRING]
    return F.when(cjk_share(title) > MOSTLY, F.coalesce(*known, F.concat(organisation, F.lit(" event"))))
