"""Cut subsequences out of reads and embed them in descriptions. Everything compiles to column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges as R

#: Opens the tags in a description; closed by a brace.
TAG_PREFIX = "SEQTAG"


def _plan(actions: list[R.Action]) -> tuple[dict[str, tuple[R.SeqRange, ...]], list[R.SeqRange]]:
    """Tags to embed, in order of declaration (of equal labels the last one holds), and ranges to trim."""
    tags = {a.label: a.ranges for a in actions if isinstance(a, (R.Embed, R.EmbedTrim))}
    cuts = [r for a in actions if isinstance(a, (R.Trim, R.EmbedTrim)) for r in a.ranges]
    return tags, cuts


def _described(desc: Column, tags: dict[str, Column], prefix: str) -> Column:
    if not tags:
        return desc
    parts = [x for label, seq in tags.items() for x in (F.lit(f"{label}:"), seq, F.lit(":"))][:-1]
    return F.concat_ws(" ", desc, F.concat(F.lit(prefix + "{"), *parts, F.lit("}")))


def _trimmed(seq: Column, text: Column, cuts: list[R.SeqRange]) -> Column:
    if not cuts:
        return text
    whole = F.concat(*[R.checked(seq, r) for r in cuts])  # every range must lie within the sequence
    return F.when(whole.isNotNull(), R.remaining(text, cuts))


def refine(
    reads: DataFrame,
    umi: R.Action | R.SeqRange | list[R.SeqRange] | None = None,
    barcode: R.Action | R.SeqRange | list[R.SeqRange] | None = None,
    extra: object = None,
    prefix: str = TAG_PREFIX,
) -> DataFrame:
    """Single reads with tags embedded in ``desc``, computed on the untrimmed bases, and ranges cut out of seq and qual.

    A range that a read doesn't reach is an error when the row is computed. Null bases stay null.
    """
    actions = [*R.action_for(umi, "UMI"), *R.action_for(barcode, "BARCODE"), *R.extra_actions(extra)]
    if not actions:
        raise ValueError("at least one action must be given")
    tags, cuts = _plan(actions)
    seq = F.col("seq")
    return reads.withColumns(
        {
            "desc": _described(F.col("desc"), {t: R.extracted(seq, r) for t, r in tags.items()}, prefix),
            "seq": _trimmed(seq, seq, cuts),
            "qual": _trimmed(seq, F.col("qual"), cuts),
        }
    )


def refine_pair(
    reads: DataFrame,
    umi1: object = None,
    barcode1: object = None,
    extra1: object = None,
    umi2: object = None,
    barcode2: object = None,
    extra2: object = None,
    prefix: str = TAG_PREFIX,
) -> DataFrame:
    """Paired reads refined mate by mate; tags of both mates (equal labels put together) go into both descriptions."""
    plans = []
    for umi, barcode, extra in ((umi1, barcode1, extra1), (umi2, barcode2, extra2)):
        plans.append(_plan([*R.action_for(umi, "UMI"), *R.action_for(barcode, "BARCODE"), *R.extra_actions(extra)]))
    if not any(tags or cuts for tags, cuts in plans):
        raise ValueError("at least one action must be given")
    tags: dict[str, Column] = {}
    for mate, (found, _) in enumerate(plans, 1):
        for label, r in found.items():
            part = R.extracted(F.col(f"seq{mate}"), r)
            tags[label] = F.concat(tags[label], part) if label in tags else part
    new = {}
    for mate, (_, cuts) in enumerate(plans, 1):
        seq = F.col(f"seq{mate}")
        new[f"desc{mate}"] = _described(F.col(f"desc{mate}"), tags, prefix)
        new[f"seq{mate}"] = _trimmed(seq, seq, cuts)
        new[f"qual{mate}"] = _trimmed(seq, F.col(f"qual{mate}"), cuts)
    return reads.withColumns(new)


def tag_map(pairs: Column) -> Column:
    """The map of an array of ``struct<key, value>``; of equal keys the last one holds."""
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def parse_tags(desc: Column, prefix: str = TAG_PREFIX) -> Column:
    """The map of tags embedded in a description; an odd last part is left out, of equal tags the last one holds."""
    body = F.regexp_extract(desc, re.escape(prefix) + r"\{([^}]*)\}", 1)
    parts = F.split(body, ":")
    n = F.floor(F.size(parts) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.get(parts, (i - 1) * 2).alias("key"), F.get(parts, (i - 1) * 2 + 1).alias("value")))
    return F.when(n >= 1, tag_map(pairs)).otherwise(F.create_map().cast("map<string,string>"))
