"""Problem 8: reading level of each document, by harmonic propagation over the graph of documents and words.

Documents and words are the nodes; an edge weighs what share of the document's spoken words the word makes up.
Graded documents are clamped to their mean grade. The levels are harmonic: every word has the weighted mean of its
documents' levels and every other document the weighted mean of its words' levels. Difficulty is thus learned from the
words that graded texts use, in any language, and reaches texts that share no word with a graded one through others.

Each iteration carries the documents' values to the words and back, which is a step of the distributed harmonic
iteration. By themselves such steps gain a factor of 0.92 each (sf0.01: 64 steps to 2e-4 grades). As a document's shares
sum to 1, the equations of the documents that are not graded are symmetric, so the steps are combined by conjugate
gradients, whose three scalars are one aggregate: some 12 steps reach the same. The iteration ends when the mean square
of the residual is below TOLERANCE squared; levels are then within some 10 * TOLERANCE of the solution.

The edges are one table bucketed by document, so that both halves of an iteration read it without a shuffle of
edges; what is shuffled is one partial row for each word and task. Words go back to the documents by broadcast while
their counted number is at most BROADCAST_WORDS. Beyond it only words of more than edges / BROADCAST_WORDS documents
are broadcast, of which there can't be more than BROADCAST_WORDS; the edges of rarer words are joined by shuffle, in
which no word is hot. Averaging draws estimates towards the middle, so they are put back on the scale of the grades by
a monotone map fitted over all graded documents; with few of these a knot of the map is the grade of one or two.

Defined results: repeated ratings of a document are averaged, null ones ignored; without any rating no level is
estimated (null). Documents with fewer than MIN_WORDS spoken words (null, empty, sounds, adverts, calls) get no
level. Repeated doc_id count as one document with all its words; rows without doc_id are left out. Documents that no
chain of words joins to a graded one get the mean grade.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.sources.tables import bucketed, materialize

TOLERANCE = 1e-4  # root mean square residual, in grades
MOST_STEPS = 200  # a guard against numbers that are none; conjugate gradients end long before
MIN_WORDS = 18  # a few calls, sounds and adverts are no prose
BINS = 20
BROADCAST_WORDS = 1_000_000  # 16 bytes each
# What is not speech. A line: blank, a cue's number or times, an address, or credits. The endings of hosts
# (the reserved ones of RFC 2606 and common ones) and the words of credit lines in five languages, all in lower case.
_HOSTS = "com|net|org|info|tv|de|fr|es|it|test|example|invalid|localhost"
_CREDITS = "subt(?:itle|[ií]tul)|untertitel|sous-titr|tra(?:nslated|du(?:c|it))|übersetz"
_BREAK = "\u0001"  # stands for lines that are no speech; no bracket reaches across it
_NOTE = "\u0002"  # stands for the sign of a song
# a look at the next character comes first, so that most places are passed over at the cost of one comparison
_LINES = rf"(?md)^(?:[ \t]*[0-9]*[ \t]*|[^\n]*?(?=[-w=hsutü.])(?:-->|w(?:ebvtt|ww\.)|==|https?:|(?<=[a-z0-9])\.(?:{_HOSTS})\b|{_CREDITS})[^\n]*)$"
# Tags and positions, sounds in brackets or stars, songs, entities. A bracket ends with its cue, and where another opens.
_MARKS = f"(?=[<{{\\[(*{_NOTE}&])(?:" + "|".join([f"<[^<>{_BREAK}]*>", rf"\{{[^{{}}{_BREAK}]*\}}", rf"\[[^\[\]{_BREAK}]*\]", f"\\([^(){_BREAK}]*\\)", f"\\*[^*\\n{_BREAK}]*\\*", f"{_NOTE}[^{_NOTE}\\n{_BREAK}]*{_NOTE}?", "&[a-z]{2,8};"]) + ")"
_SPEAKER = r"(?md)^-?[ \t]*\p{Lu}{2,}:"


def speech(text: Column) -> Column:
    """The spoken words of a subtitle file, in lower case. Each pattern passes once over the text, whatever its length."""
    for old, new in (("\r", ""), (_BREAK, ""), (_NOTE, ""), ("♪", _NOTE)):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.lower(F.regexp_replace(text, _SPEAKER, " "))
    return F.regexp_replace(F.regexp_replace(text, _LINES, _BREAK), _MARKS, " ")


def edges(documents: DataFrame) -> DataFrame:
    """doc_id, word (64-bit hash), n: the spoken words of each document, counted."""
    words = documents.filter("doc_id is not null and text is not null").select("doc_id", F.explode(F.regexp_extract_all(speech(F.col("text")), F.lit(r"\p{L}+"), 0)).alias("w"))
    counted = words.select("doc_id", F.xxhash64("w").alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return counted


class Graph:
    """Edges doc_id, word, share, hot, bucketed by document, and the steps over them."""

    def __init__(self, documents: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> None:
        spark = documents.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), documents.rdd.getNumPartitions())  # follows the input
        counted = bucketed(edges(documents), "doc_id", parts, "counts")
        self.size = materialize(counted.groupBy("doc_id").agg(F.sum("n").alias("n_words")), "sizes")
        self.edges = counted.join(self.size, "doc_id").select("doc_id", "word", (F.col("n") / F.col("n_words")).alias("share"), F.lit(True).alias("hot"))
        spread = materialize(counted.groupBy("word").agg(F.count("*").alias("n_docs")), "spread")
        self.few = spread.count() <= broadcast_words
        if not self.few:
            most = spread.agg(F.sum("n_docs")).first()[0] / broadcast_words
            hot = spread.filter(F.col("n_docs") > most).select("word", F.lit(True).alias("_hot"))  # fewer than broadcast_words, as their edges would exceed all
            self.edges = self.edges.drop("hot").join(F.broadcast(hot), "word", "left").withColumn("hot", F.col("_hot").isNotNull()).drop("_hot")
        self.edges = bucketed(self.edges, "doc_id", parts, "edges")

    def through_words(self, values: DataFrame) -> DataFrame:
        """doc_id, mean: of every document the mean over its words of the mean over the words' documents of ``v`` (doc_id, v; 0
        for documents that are not there)."""
        share = F.col("share")
        words = self.edges.join(values, "doc_id", "left").groupBy("word", "hot").agg((F.sum(share * F.coalesce("v", F.lit(0.0))) / F.sum(share)).alias("wv"))
        if self.few:
            back = self.edges.join(F.broadcast(words.drop("hot")), "word")
        else:
            words = materialize(words, "words")
            side = lambda hot, w: self.edges.filter(F.col("hot") == hot).drop("hot").join(w, "word")
            back = side(True, F.broadcast(words.filter("hot").drop("hot"))).unionByName(side(False, words.filter("not hot").drop("hot")))
        return back.groupBy("doc_id").agg(F.sum(share * F.col("wv")).alias("mean"))


def harmonic(graph: Graph, graded: DataFrame, middle: float, tolerance: float = TOLERANCE) -> tuple[DataFrame, int]:
    """(doc_id, v: grade where there is one, else the harmonic level; number of steps)."""
    docs = graph.size.select("doc_id").join(graded, "doc_id", "left")
    start = docs.select("doc_id", F.coalesce("grade", F.lit(middle)).alias("v"))
    first = graph.through_words(start).join(graded, "doc_id", "left_anti")
    # x: level, r: residual, p: direction, q: what the equations make of p
    r = F.col("mean") - middle
    state = materialize(first.select("doc_id", F.lit(float(middle)).alias("x"), r.alias("r"), r.alias("p")), "state")
    rr, n = state.agg(F.sum(F.col("r") * F.col("r")), F.count("*")).first()
    step = 0
    while n and math.isfinite(rr) and rr > tolerance * tolerance * n and step < MOST_STEPS:
        step += 1
        through = graph.through_words(state.select("doc_id", F.col("p").alias("v")))
        both = materialize(state.join(through, "doc_id").withColumn("q", F.col("p") - F.col("mean")).drop("mean"), f"step{step}")
        dot = lambda a, b: F.sum(F.col(a) * F.col(b))
        pq, rq, qq = both.agg(dot("p", "q"), dot("r", "q"), dot("q", "q")).first()
        if not pq > 0:  # documents that no graded one reaches keep the middle
            break
        a = rr / pq
        left = max(rr - 2 * a * rq + a * a * qq, 0.0)
        r = F.col("r") - a * F.col("q")
        state = both.select("doc_id", (F.col("x") + a * F.col("p")).alias("x"), r.alias("r"), (r + left / rr * F.col("p")).alias("p"))
        rr = left
    return docs.join(state.select("doc_id", "x"), "doc_id", "left").select("doc_id", F.coalesce("grade", "x").alias("v")), step


def estimate_levels(documents: DataFrame, labels: DataFrame, min_words: int = MIN_WORDS, tolerance: float = TOLERANCE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, n_words, level (on the scale of the ratings) of each document with enough spoken words."""
    graph = Graph(documents, broadcast_words)
    graded = labels.filter("doc_id is not null and read_level is not null").groupBy("doc_id").agg(F.avg("read_level").alias("grade"))
    graded = materialize(graded, "graded")
    middle = graded.agg(F.avg("grade")).first()[0]
    prose = graph.size.filter(F.col("n_words") >= min_words)
    if middle is None:
        return prose.select("doc_id", "n_words", F.lit(None).cast("double").alias("level"))
    levels, _ = harmonic(graph, graded, middle, tolerance)
    out = materialize(graph.through_words(levels), "levels").withColumnRenamed("mean", "free")
    knots = calibration(out.join(graded, "doc_id"))
    return prose.join(out, "doc_id").select("doc_id", "n_words", (on_scale(F.col("free"), knots) if knots else F.lit(middle)).alias("level"))


def calibration(graded: DataFrame, bins: int = BINS) -> list[tuple[float, float]]:
    """Knots (estimate, grade) of a monotone map from estimates ``free`` to grades, fitted over all graded documents.

    Spark averages grades and estimates in ``bins`` quantile bins; of those few rows, neighbours that fall are pooled.
    """
    cuts = graded.agg(F.percentile_approx("free", [k / bins for k in range(1, bins)], 10000)).first()[0] or []
    bin_ = sum((F.when(F.col("free") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    means = graded.groupBy(bin_.alias("b")).agg(F.avg("free").alias("x"), F.avg("grade").alias("y"), F.count("*").alias("n"))
    pools: list[list] = []  # mean grade, weight, estimates
    for r in means.orderBy("b").collect():  # at most ``bins`` rows
        pools.append([r.y, r.n, [r.x]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            (y1, n1, x1), (y2, n2, x2) = pools[-2:]
            pools[-2:] = [[(y1 * n1 + y2 * n2) / (n1 + n2), n1 + n2, x1 + x2]]
    return [(x, y) for y, _, xs in pools for x in xs]


def on_scale(free: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear interpolation between the knots, held constant beyond the first and the last; null stays null."""
    out = F.when(free <= knots[0][0], knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(free <= x1, y0 + (free - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0))
    return out.when(free > knots[-1][0], knots[-1][1])
