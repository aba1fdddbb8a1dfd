"""Parsed sentences back to the rows of their batch.

A batch is one row that carries its examples as an array, at most the batch size
of them. Parsing and matching a reply then need no join: both are array
expressions over that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import PAIRS, bullet_phrases, parse_cascade, reply_lines
from ..functions.text import let, normalize_text

PREFIX_LENGTH = 20


def _first(rows: Column, test) -> Column:
    return F.try_element_at(F.filter(rows, test), F.lit(1))


def bullet_pairs(text: Column, rows: Column) -> Column:
    """Reply lines that hold a row's text (or lie inside it), any case.

    The first such row takes the line; the phrases follow the last colon, and
    lines without phrases are dropped.
    """

    def pair(line: Column, lowered_rows: Column) -> Column:
        def touches(lowered: Column) -> Column:
            return _first(
                lowered_rows,
                lambda r: lowered.contains(r["lowered"]) | r["lowered"].contains(lowered),
            )["text"]

        sentence = let(F.lower(line), touches)
        return F.struct(sentence.alias("sentence"), bullet_phrases(line).alias("phrases"))

    lowered_rows = F.transform(
        rows, lambda r: F.struct(r["text"].alias("text"), F.lower(r["text"]).alias("lowered"))
    )
    pairs = let(lowered_rows, lambda rs: F.transform(reply_lines(text), lambda line: pair(line, rs)))
    return F.filter(
        pairs, lambda p: p["sentence"].isNotNull() & (F.size(p["phrases"]) > 0)
    ).cast(PAIRS)


def parse_phrases(replies: DataFrame, text: str = "text", rows: str = "rows") -> DataFrame:
    """Adds ``strategy`` and ``pairs``: the first parser that finds a pair wins."""
    parsed = parse_cascade(F.col(text), bullet_pairs(F.col(text), F.col(rows)))
    return replies.withColumn("_parsed", parsed).select(
        *replies.columns, "_parsed.strategy", "_parsed.pairs"
    )


def match_rows(parsed: DataFrame) -> DataFrame:
    """Adds ``matches``: each parsed pair with the row of the batch it belongs to.

    An exactly equal text wins. Otherwise the first row counts whose normalised
    text is equal, or, for normalised sentences of 20 characters and more, where
    one of both begins with the other. Position decides, not closeness.
    """

    def loose(norm: Column, row: Column) -> Column:
        prefix = row["norm"].startswith(norm) | norm.startswith(row["norm"])
        return (norm == row["norm"]) | ((F.length(norm) >= PREFIX_LENGTH) & prefix)

    def match(pair: Column, rows: Column) -> Column:
        exact = _first(rows, lambda r: r["text"] == pair["sentence"])
        near = let(
            normalize_text(pair["sentence"]), lambda norm: _first(rows, lambda r: loose(norm, r))
        )

        def outcome(kind: str, row: Column) -> Column:
            return F.struct(
                pair["sentence"].alias("sentence"),
                pair["phrases"].alias("phrases"),
                F.when(row.isNotNull(), F.lit(kind)).alias("match"),
                row["id"].alias("id"),
                row["text"].alias("ori_text"),
                row["ord"].alias("ord"),
            )

        return let(
            exact,
            lambda row: F.when(row.isNotNull(), outcome("exact", row)).otherwise(
                let(near, lambda other: outcome("loose", other))
            ),
        )

    with_norm = F.transform(
        F.col("rows"),
        lambda r: F.struct(
            r["id"].alias("id"),
            r["text"].alias("text"),
            r["ord"].alias("ord"),
            normalize_text(r["text"]).alias("norm"),
        ),
    )
    matches = let(with_norm, lambda rows: F.transform("pairs", lambda p: match(p, rows)))
    return parsed.withColumn("matches", matches)


def match_sentences(matched: DataFrame) -> DataFrame:
    """One pattern row per matched pair; ``pair_no`` is its place in the reply."""
    # An outer explode: the plain one adds a size filter that would parse and match twice.
    exploded = matched.select(
        "label", "batch_no", "strategy", F.posexplode_outer("matches").alias("pair_no", "_m")
    ).filter(F.col("_m.match").isNotNull())
    return exploded.select(
        "batch_no",
        "strategy",
        "pair_no",
        "_m.match",
        "_m.id",
        "_m.ori_text",
        "_m.ord",
        F.col("label").alias("ori_label"),
        "_m.phrases",
        F.array_join("_m.phrases", ", ").alias("pattern"),
    )


def parse_report(matched: DataFrame) -> DataFrame:
    """Parsed and matched pairs per batch, with the strategy that was used.

    ``duplicates`` counts matches that attach a further pair to a row already taken.
    """
    hits = F.filter("matches", lambda p: p["match"].isNotNull())
    ids = F.array_distinct(F.transform(hits, lambda p: p["id"]))
    return matched.select(
        "label",
        "batch_no",
        "strategy",
        F.size("pairs").alias("n_pairs"),
        F.size(hits).alias("n_matched"),
        (F.size(hits) - F.size(ids)).alias("duplicates"),
    )


def report_totals(report: DataFrame) -> DataFrame:
    """The report summed per label and strategy."""
    return report.groupBy("label", "strategy").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("n_pairs").alias("n_pairs"),
        F.sum("n_matched").alias("n_matched"),
        F.sum("duplicates").alias("duplicates"),
    )
