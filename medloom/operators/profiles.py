"""Multi-source profiles: HTML extraction, first-filled merges, token tagging, votes."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The named character references that pages use.
ENTITIES = {"&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}


def unescaped(html: Column) -> Column:
    for name, value in ENTITIES.items():
        html = F.replace(html, F.lit(name), F.lit(value))
    return html


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def og_values(html: Column, name: str) -> Column:
    """All contents of a meta property."""
    return F.regexp_extract_all(html, F.lit(rf'(?is)<meta[^>]*property="{name}"[^>]*content="([^"]*)"'), F.lit(1))


def inline_value(html: Column, label: str) -> Column:
    """The text right after a label, in the same or the next element."""
    return F.trim(F.regexp_extract(html, rf"(?is){label}\s*(?:</?\w[^>]*>\s*)*([^<]+)", 1))


def label_value(html: Column, label: str) -> Column:
    """The first text in the elements after a label's own element."""
    return F.trim(F.regexp_extract(html, rf"(?is)>\s*{label}\s*(?:<!--.*?-->)?\s*:?\s*</\w+>\s*(?:</?\w[^>]*>\s*)*([^<]+)", 1))


def attribute_text(html: Column, attribute: str, value: str) -> Column:
    return F.trim(F.regexp_extract(html, rf'(?is){attribute}="{value}"[^>]*>([^<]+)<', 1))


def links(text: Column, pattern: str = r"(?s)<loc>(.*?)</loc>") -> Column:
    """All locations of a site map."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.trim)


def embedded_json(html: Column, path: str) -> Column:
    """A value of the JSON document that a page embeds for its own script."""
    return F.get_json_object(F.regexp_extract(html, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), path)


def merge_first_filled(records: DataFrame, key: str, rank: str, scalars: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """One profile per key: of each scalar the first value by rank that is not blank; arrays joined without repeats, in rank order."""
    picks = [F.min_by(c, F.when(F.trim(F.col(c).cast("string")) != "", F.struct(rank, F.col(c)))).alias(c) for c in scalars]
    for c in arrays:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("_rank"), F.col(c).alias("_item"))))
        filled = F.filter(ordered, lambda s: s["_item"].isNotNull())
        picks.append(F.array_distinct(F.flatten(F.transform(filled, lambda s: s["_item"]))).alias(c))
    return records.groupBy(key).agg(*picks)


def bio_tags(blocks: DataFrame, block: str, text: Column, is_drug: Column) -> DataFrame:
    """One row per token: O outside drugs, B-DRUG for the first token of a drug block, I-DRUG for the rest."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    rows = blocks.select(block, is_drug.alias("_drug"), F.posexplode(tokens).alias("pos", "token"))
    tag = F.when(~F.col("_drug"), "O").when(F.col("pos") == 0, "B-DRUG").otherwise("I-DRUG")
    return rows.select(block, "pos", "token", tag.alias("tag"))


def consensus(texts: DataFrame, group: str, image: str, text: str, confidence: str, ratio: float = 0.6, shortest: int = 5) -> DataFrame:
    """Votes over images: texts join the first cluster whose first member is similar; clusters of two images or more count.

    Order-dependent within one group (a batch of images of one prescription), so each group is a unit of work.
    """

    def vote(pdf: pd.DataFrame) -> pd.DataFrame:
        clusters: list[list] = []
        for row in pdf.sort_values([image, text], kind="stable").itertuples(index=False):
            value = getattr(row, text)
            if value is None or len(value) < shortest:
                continue
            for c in clusters:
                if SequenceMatcher(None, getattr(c[0], text).lower(), value.lower()).ratio() >= ratio:
                    c.append(row)
                    break
            else:
                clusters.append([row])
        out = []
        for c in clusters:
            images = {getattr(r, image) for r in c}
            if len(images) >= 2:
                names = [getattr(r, text) for r in c]
                name = max(dict.fromkeys(names), key=names.count)
                out.append((pdf[group].iloc[0], name, names.count(name), len(images), round(sum(getattr(r, confidence) for r in c) / len(c), 2)))
        return pd.DataFrame(out, columns=[group, "name", "votes", "images", "confidence"])

    kind = dict(texts.dtypes)[group]
    return texts.select(group, image, text, confidence).groupBy(group).applyInPandas(vote, f"{group} {kind}, name string, votes long, images long, confidence double")
