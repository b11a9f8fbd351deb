"""Licence scans: a trained paragraph classifier whose findings templates confirm.

Paragraphs become sparse word n-grams; a multinomial logistic regression over licence families
and plain text is trained on spans of the templates and on a bounded sample of paragraphs of the
corpus.  Probabilities are calibrated by a temperature fitted on held-out spans.  A paragraph that
reads like a licence, but for which no family is likely enough or no template agrees, is
``unknown``.  All steps are DataFrame operations.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.notices import LICENCE_WORDS, OTHERS, PLAIN, TELLING, TEMPLATES, UNKNOWN
from tillroll.sources.staging import staged

SAMPLE_DOCS = 300
EDGES = ".,;:!?()[]{}<>\"'*#&%$|/"
# A blank line ends a paragraph, and so does a line that ends a sentence; other lines are wrapped.
PARAGRAPH_END = r"\n[ \t\r]*\n|(?<=[.!?:][^\p{L}\p{N}\n]{0,8})\n"
SPAN_WORDS = (4, 6, 8, 12, 20, 40)
FOLDS = 5
MARKER = "spdx-license-identifier"
FEATURES, PREDICTION, RAW = "_licence_features", "_licence_class", "_licence_scores"

def words_of(text: Column) -> Column:
    """Lower-case words between white space, without punctuation around them."""
    return F.filter(
        F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.btrim(w, F.lit(EDGES))), lambda w: w != ""
    )


def grams_of(words: Column) -> Column:
    """Pairs of neighbouring words; a lone word is its own gram."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), _pair)
    return F.when(F.size(words) > 1, F.slice(pairs, 1, F.size(words) - 1)).otherwise(words)


def _pair(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" "), F.coalesce(b, F.lit("")))


def _template_grams(text: str) -> list[str]:
    words = [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]
    return sorted({" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))})


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per paragraph with a letter: the row of ``docs``, ``paragraph`` number and its text as ``line``."""
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*kept, F.posexplode(F.split(F.col(text), PARAGRAPH_END)).alias("paragraph", "line"))
    return rows.where(F.col("line").rlike(r"\p{L}"))


def _vectors(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Sparse vectors over the word pairs of the notices and the words that speak of licences."""
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_terms", outputCol=FEATURES, binary=True)
    return counter.transform(df.withColumn("_terms", F.concat("_grams", "_words"))).drop("_terms")


def _index(labels: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("family")) - 1).cast("double")


def _spans(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """Whole notices and word spans of them, the training rows of the families, with the fold of the notice."""
    rows = spark.createDataFrame([(f, t, i % FOLDS) for i, (f, t) in enumerate(known)], "family string, line string, fold int")
    rows = rows.withColumn("words", words_of(F.col("line")))
    cuts = F.array(*[F.lit(n) for n in SPAN_WORDS])
    starts = F.explode(F.sequence(F.lit(1), F.size("words"), F.lit(2)))
    spans = rows.withColumn("n", F.explode(cuts)).withColumn("at", starts).select(
        "family", F.slice("words", F.col("at"), F.col("n")).alias("words"), "fold"
    ).where(F.size("words") >= 4)
    every = rows.select("family", "words", "fold").unionByName(spans)
    return every.groupBy("family", "words").agg(F.min("fold").alias("fold"))


class LicenceModel(NamedTuple):
    classifier: object
    vocabulary: list[str]
    labels: list[str]
    temperature: float
    notices: list[tuple[str, str]]


def _sample_lines(docs: DataFrame, text: str, sample_docs: int) -> DataFrame:
    """Distinct lines of the ``sample_docs`` distinct texts of least hash."""
    hashed = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("h")).where("text is not null")
    least = hashed.select("h").distinct().orderBy("h").limit(sample_docs)
    texts = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.min("text").alias("text"))
    return paragraphs(texts.select("text")).select("line").distinct()


def fit(
    docs: DataFrame,
    text: str = "text",
    sample_docs: int = SAMPLE_DOCS,
    notices: list[tuple[str, str]] | None = None,
) -> LicenceModel:
    """Train on spans of ``notices`` (family, paragraph) and on plain paragraphs of ``sample_docs`` documents.

    Paragraphs of the corpus that hold half of the pairs of a notice, or lie half in one, or hold a
    ``TELLING`` word are not taught as plain: a notice of a family not listed must not become prose.
    The temperature comes from a model that has not seen a fifth of the notices.
    """
    spark = docs.sparkSession
    notices = TEMPLATES if notices is None else notices
    labels = [PLAIN, UNKNOWN, *sorted({f for f, _ in notices})]
    # An identifier of no family is any word: the marker before it has to speak for itself.
    pairs = {
        g for f, t in notices + OTHERS for g in _template_grams(t) if f != UNKNOWN or not g.startswith(MARKER)
    }
    vocabulary = sorted(pairs | set(LICENCE_WORDS))
    lines = staged(_sample_lines(docs, text, sample_docs).select(words_of(F.col("line")).alias("words")), "lines")
    lines = lines.where(F.size("words") > 0)
    lines = staged(lines.select("words", grams_of(F.col("words")).alias("grams")), "grams")
    telling = F.arrays_overlap("words", F.array(*[F.lit(w) for w in TELLING]))
    plain = lines.where(~telling & (_agreement(F.col("grams"), None, notices) < 0.5))
    fold = F.pmod(F.xxhash64(F.lit(3), "words"), F.lit(FOLDS)).cast("int")
    plain = plain.select(F.lit(PLAIN).alias("family"), "words", fold.alias("fold"))
    rows = _spans(spark, notices + OTHERS).unionByName(plain)
    rows = staged(rows.select("words", _index(labels).alias("label"), "fold"), "licences")
    rows = rows.select(F.col("words").alias("_words"), grams_of(F.col("words")).alias("_grams"), "label", "fold")
    vectors = staged(_vectors(rows, vocabulary).select(FEATURES, "label", "fold"), "vectors")

    def trained(part: DataFrame):
        return LogisticRegression(
            featuresCol=FEATURES,
            labelCol="label",
            predictionCol=PREDICTION,
            rawPredictionCol=RAW,
            probabilityCol="",
            family="multinomial",
            regParam=1e-4,
            maxIter=60,
        ).fit(part)

    # A family whose notices are all in the held-out fold has no score to calibrate.
    seen = vectors.where("fold > 0")
    held_out = vectors.where("fold = 0").join(F.broadcast(seen.select("label").distinct()), "label", "left_semi")
    temperature = _temperature(trained(seen), held_out)
    return LicenceModel(trained(vectors), vocabulary, labels, temperature, notices)


def _temperature(model, held_out: DataFrame) -> float:
    """The divisor of the raw scores, 3 at most, that makes held-out notices most likely."""
    raw = model.transform(held_out).select("label", vector_to_array(RAW).alias("raw"))
    raw = staged(raw, "held-out")
    grid = [0.25, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0]
    tried = raw.withColumn("t", F.explode(F.array(*[F.lit(t) for t in grid])))
    top = F.array_max("raw")
    total = F.aggregate(F.transform("raw", lambda x: F.exp((x - top) / F.col("t"))), F.lit(0.0), lambda a, x: a + x)
    own = (F.get("raw", F.col("label").cast("int")) - top) / F.col("t")
    loss = tried.groupBy("t").agg(F.avg(F.log(total) - own).alias("loss")).orderBy("loss", "t").first()
    return float(loss["t"]) if loss else 1.0


def _shared_pairs(notices: list[tuple[str, str]]) -> set[str]:
    """Pairs that notices of several families hold, as ``under the``: they tell no family from another."""
    families: dict[str, set[str]] = {}
    for family, text in notices + OTHERS:
        for gram in _template_grams(text):
            families.setdefault(gram, set()).add(family)
    return {gram for gram, held in families.items() if len(held) > 1}


def _agreement(grams: Column, family: Column | None, notices: list[tuple[str, str]]) -> Column:
    """How far a paragraph and a template hold each other, the best of the family's templates.

    The larger of the shares of the paragraph's pairs in the template and of the template's in the
    paragraph, of pairs that are not shared by several families.  Without a family the best of all
    templates.
    """
    out = F.lit(0.0)
    shared = _shared_pairs(notices)
    own = F.array_except(grams, F.array(*[F.lit(g) for g in sorted(shared)]))
    for name in sorted({f for f, _ in notices}):
        best = [F.lit(0.0)]
        for held in (set(_template_grams(t)) - shared for f, t in notices if f == name):
            if held:
                common = F.size(F.array_intersect(own, F.array(*[F.lit(g) for g in sorted(held)])))
                best.append(common / F.greatest(F.least(F.size(own), F.lit(len(held))), F.lit(1)))
        top = F.greatest(*best) if len(best) > 1 else best[0]
        out = F.greatest(out, top) if family is None else F.when(family == name, top).otherwise(out)
    return out


def scan(
    docs: DataFrame,
    model: LicenceModel,
    text: str = "text",
    likely: float = 0.5,
    agreeing: float = 0.5,
) -> DataFrame:
    """One row per paragraph that reads like a licence, whatever its family.

    The columns of ``docs`` but the text, then ``paragraph`` (its number in the text, from 0), ``family``,
    ``probability`` (of the likeliest licence family), ``agreement`` with the family's templates
    and ``confirmed``.  Families that are not likely or not confirmed become ``unknown``.  Null and empty
    texts have no paragraph; repeated rows are scanned like any other; columns of the given result names
    are replaced, all others kept, whatever their names.
    """
    made = ("paragraph", "family", "probability", "agreement", "confirmed")
    kept = [c for c in docs.columns if c != text and c not in made]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row") if kept else F.lit(None).alias("_row"), text)
    rows = paragraphs(packed, text).withColumn("_words", words_of(F.col("line"))).drop("line")
    vectors = _vectors(rows.withColumn("_grams", grams_of(F.col("_words"))), model.vocabulary)
    scored = model.classifier.transform(vectors).where(F.col(PREDICTION) > 0)  # class 0 is plain text
    # The generator keeps the optimiser from writing the classifier into every use of its scores.
    scored = scored.select(
        "_row", "paragraph", "_grams", F.explode(F.array(vector_to_array(RAW))).alias("_raw")
    )
    top = F.array_max("_raw")
    odds = F.transform("_raw", lambda x: F.exp((x - top) / model.temperature))
    scored = scored.withColumn("_odds", odds).where(F.size("_grams") > 0)
    total = F.aggregate("_odds", F.lit(0.0), lambda a, x: a + x)
    found = scored.withColumn("_p", F.transform("_odds", lambda x: x / total))
    families = F.slice("_p", 3, len(model.labels) - 2)
    names = F.array(*[F.lit(x) for x in model.labels[2:]])
    best = F.array_max(families)
    family = F.get(names, (F.array_position(families, best) - 1).cast("int"))
    found = found.withColumn("_family", family).withColumn("probability", best)
    found = found.withColumn("agreement", _agreement(F.col("_grams"), F.col("_family"), model.notices))
    confirmed = (F.col("probability") >= likely) & (F.col("agreement") >= agreeing)
    return found.select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        F.col("paragraph").cast("bigint").alias("paragraph"),
        F.when(confirmed, F.col("_family")).otherwise(UNKNOWN).alias("family"),
        "probability",
        "agreement",
        confirmed.alias("confirmed"),
    )
