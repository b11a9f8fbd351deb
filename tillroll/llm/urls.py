"""URL filters: fixed rules by host and path, and boosted trees on lexical features for the rest.

Trees learn from URLs that are labelled already (here: those that a rule decides), a bounded
sample of them chosen by hash and weighted by the classes' full counts.  Statistics of host
suffixes come from all labelled URLs and are joined back by key: keys of many pages are
broadcast, a bounded number of them, and the rest shuffles.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.joins import HOT_PARTS, SALTS
from tillroll.sources.staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE_ROWS = 20_000
PRIOR_ROWS = 20.0  # how many rows of the overall share each suffix statistic starts from
KINDS = ("suffix", "site", "first_part")  # the keys of a URL that have a share of blocked URLs
FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "host_labels",
    "digit_ratio", "upper_ratio", "mark_ratio", "entropy", "path_entropy", "longest_label",
    "hyphens", "parameters", "fragment", "secure", "has_port", "extension_length",
    "first_part_length", "suffix_share", "site_share", "first_part_share",
)


class Rule(NamedTuple):
    """``pattern`` is host, then the start of the path from its first slash."""

    verdict: str
    pattern: str


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters in lower case."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits, null if none does."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.pattern)):  # the longest is asked first
        domain, slash, rest = rule.pattern.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        pattern = F.when(fits, F.lit(rule.pattern)).otherwise(pattern)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return pattern, verdict


def _entropy(text: Column) -> Column:
    """Bits per character; 0 for the empty text."""
    total = F.length(text)
    chars = F.split(text, "")
    parts = F.transform(
        F.array_distinct(chars),
        lambda c: (total - F.length(F.replace(text, c, F.lit("")))) / total,
    )
    bits = F.aggregate(
        F.filter(parts, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p)
    )
    return F.when(total > 0, bits).otherwise(0.0)


def _ratio(text: Column, kept: str) -> Column:
    """Share of characters inside a character class."""
    removed = F.length(F.regexp_replace(text, f"[{kept}]", ""))
    return F.when(F.length(text) > 0, 1.0 - removed / F.length(text)).otherwise(0.0)


def _first_part(path: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(0)), F.lit(""))


def _keys(url: Column) -> Column:
    """Struct of the keys by which shares of blocked URLs are kept."""
    labels = F.split(host_of(url), r"\.")
    keys = {
        "suffix": F.element_at(labels, -1),
        "site": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)),
        "first_part": _first_part(path_of(url)),
    }
    return F.struct(*[keys[k].alias(k) for k in KINDS])


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with struct ``_lex``: features of the text of a URL; null URLs count as empty."""
    full = F.coalesce(F.col(url), F.lit(""))
    host, path = F.col("_host"), F.col("_path")
    query = F.regexp_extract(full, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first = _first_part(path)
    name = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))
    values = {
        "url_length": F.length(full),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "query_length": F.length(query),
        "depth": F.size(parts),
        "host_labels": F.size(labels),
        "digit_ratio": _ratio(full, "0-9"),
        "upper_ratio": _ratio(full, "A-Z"),
        "mark_ratio": _ratio(full, "^A-Za-z0-9"),
        "entropy": _entropy(full),
        "path_entropy": _entropy(path),
        "longest_label": F.array_max(F.transform(labels, F.length)),
        "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")),
        "fragment": F.instr(full, "#") > 0,
        "secure": F.startswith(F.lower(full), F.lit("https")),
        "has_port": F.instr(host, ":") > 0,
        "extension_length": F.length(F.regexp_extract(name, r"\.([^.]*)$", 1)),
        "first_part_length": F.length(first),
    }
    names = [F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in values.items()]
    prepared = df.withColumn("_host", host_of(F.col(url))).withColumn("_path", path_of(F.col(url)))
    return prepared.withColumn("_lex", F.struct(*names)).drop("_host", "_path")


class UrlModel(NamedTuple):
    """Fitted trees, the statistics per key and the overall share of blocked URLs."""

    trees: object  # None if there was one class only
    shares: DataFrame
    overall: float


def _long(keyed: DataFrame, *columns: str) -> DataFrame:
    """One row per row of ``keyed`` and kind: ``columns``, ``kind`` and ``key``."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_keys.{k}").alias("key")) for k in KINDS])
    return keyed.select(*columns, F.explode(kinds).alias("_at")).select(*columns, "_at.kind", "_at.key")


def _shares(labelled: DataFrame, overall: float) -> DataFrame:
    """Share of blocked URLs per (kind, key), drawn towards the overall share."""
    return _long(labelled, "_label").groupBy("kind", "key").agg(
        ((F.sum("_label") + PRIOR_ROWS * overall) / (F.count(F.lit(1)) + PRIOR_ROWS)).alias("share")
    )


def _with_shares(df: DataFrame, url: str, shares: DataFrame, overall: float) -> DataFrame:
    """``df`` as struct ``_row``, its URL as ``_url``, and ``_s_*``, the share of each of its keys.

    The table of shares has no bound.  Keys of more than one row in ``HOT_PARTS`` are broadcast,
    fewer than ``HOT_PARTS`` a kind, and their rows salted past the shuffle join of the others.
    """
    hashable = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = df.select(
        F.struct("*").alias("_row"), F.col(url).alias("_url"), F.xxhash64(*hashable).alias("_spread"),
        _keys(F.col(url)).alias("_keys"),
    )
    sizes = _long(keyed).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    frame = staged(sizes.join(shares, ["kind", "key"], "left"), "url-keys")
    total = frame.where(F.col("kind") == KINDS[0]).agg(F.sum("n")).first()[0] or 0
    out = keyed
    for kind in KINDS:
        own, hot = F.col("kind") == kind, F.col("n") * HOT_PARTS > total
        share = F.coalesce("share", F.lit(overall))
        few = frame.where(own & hot).select(F.col("key").alias("_few"), share.alias("_few_share"))
        # Always 0, in a form that is not folded: a constant would drop out of the join keys.
        zero = F.when(F.col("n") < 0, 1).otherwise(0).cast("bigint")
        many = frame.where(own & ~hot).select(
            F.col("key").alias("_many"), zero.alias("_many_salt"), share.alias("_many_share")
        )
        out = out.join(F.broadcast(few), F.col(f"_keys.{kind}") == F.col("_few"), "left")
        salt = F.when(F.col("_few").isNotNull(), 1 + F.pmod("_spread", F.lit(SALTS))).otherwise(0)
        out = out.withColumn("_salt", salt.cast("bigint"))
        met = (F.col(f"_keys.{kind}") == F.col("_many")) & (F.col("_salt") == F.col("_many_salt"))
        out = out.join(many, met, "left").withColumn(f"_s_{kind}", F.coalesce("_few_share", "_many_share"))
        out = out.drop("_few", "_few_share", "_salt", "_many", "_many_salt", "_many_share")
    return out.drop("_spread", "_keys")


def _vectors(df: DataFrame, url: str, shares: DataFrame, overall: float) -> DataFrame:
    """``df`` as struct ``_row``, and ``_vector``."""
    out = lexical(_with_shares(df, url, shares, overall), "_url")
    lexical_names = [f for f in FEATURES if not f.endswith("_share")]
    flat = out.select(
        "_row",
        *[F.col(f"_lex.{f}").alias(f"_f_{f}") for f in lexical_names],
        *[F.col(f"_s_{k}").alias(f"_f_{k}_share") for k in KINDS],
    )
    columns = [f"_f_{f}" for f in FEATURES]
    return VectorAssembler(inputCols=columns, outputCol="_vector").transform(flat).drop(*columns)


def _least_hashed(share: float) -> Column:
    """Whether the hash of a URL is among the lowest ``share`` of all possible hashes."""
    return F.lit(True) if share >= 1 else F.xxhash64("url") < F.lit(int(share * 2**64) - 2**63)


def _sample(known: DataFrame, counts: tuple[int, int], most: int) -> DataFrame:
    """The ``most`` distinct URLs of least hash of each label, 0 and 1, of which there are ``counts``.

    Only hashes below a bound that lets little more than ``most`` pass are ranked, since a label's
    rows meet in one task; should too few pass, the bound is doubled.
    """
    parts = []
    for label, count in enumerate(counts):
        own, share = known.where(F.col("_label") == label), (most + 10 * most**0.5 + 100) / count
        while share < 1 and own.where(_least_hashed(share)).count() < most:
            share *= 2
        parts.append(own.where(_least_hashed(share)))
    place = Window.partitionBy("_label").orderBy(F.xxhash64("url"), "url")
    ranked = parts[0].unionByName(parts[1]).withColumn("_place", F.row_number().over(place))
    return ranked.where(F.col("_place") <= most).drop("_place")


def fit(
    labelled: DataFrame, url: str = "url", label: str = "label", sample_rows: int = SAMPLE_ROWS,
    trees: int = 20, depth: int = 4,
) -> UrlModel:
    """Learn blocked (1) from allowed (0) URLs.

    Shares are those of all distinct URLs.  The trees see the ``sample_rows / 2`` of least hash of
    each class, weighted so that each class counts as it does among all.  With only one class, or
    none, there are no trees and every URL gets that class (none: allowed).
    """
    known = labelled.select(F.col(url).alias("url"), F.col(label).cast("int").alias("_label"))
    known = staged(known.where("url is not null and _label is not null").distinct(), "url-labels")
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum("_label").alias("bad")).first()
    n, bad = counts["n"], counts["bad"] or 0
    overall = bad / n if n else 0.0
    shares = staged(_shares(known.withColumn("_keys", _keys(F.col("url"))), overall), "shares")
    model = None
    if 0 < bad < n:
        # A bounded table, read back in few partitions: the trees pass over it a hundred times.
        rows = staged(_sample(known, (n - bad, bad), sample_rows // 2), "url-sample")
        taken = [min(c, sample_rows // 2) for c in (n - bad, bad)]
        scale = sum(taken) / n
        weight = F.when(F.col("_row._label") == 1, bad / taken[1] * scale).otherwise((n - bad) / taken[0] * scale)
        data = _vectors(rows, "url", shares, overall)
        data = data.select("_vector", F.col("_row._label").cast("double").alias("_label"), weight.alias("_weight"))
        data = staged(data, "url-vectors")
        model = GBTClassifier(
            featuresCol="_vector", labelCol="_label", weightCol="_weight", maxIter=trees, maxDepth=depth,
            stepSize=0.2, subsamplingRate=1.0, seed=7, maxBins=32,
        ).fit(data)
    return UrlModel(model, shares, overall)


def predict(df: DataFrame, model: UrlModel, url: str = "url", out: str = "block_score") -> DataFrame:
    """``df`` and the probability that a URL is to be blocked, in ``out``."""
    df = df.drop(out)
    if model.trees is None:
        return df.withColumn(out, F.lit(float(model.overall >= 0.5)))
    scored = model.trees.transform(_vectors(df, url, model.shares, model.overall))
    return scored.select("_row.*", vector_to_array("probability")[1].alias(out))


def judge(
    pages: DataFrame, rules: list[Rule], url: str = "url", sample_rows: int = SAMPLE_ROWS,
    threshold: float = 0.5,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``block_score`` and ``verdict``.

    The verdict is that of the longest rule that fits, else the trees'.  A null URL, or one
    without ``://``, has an empty host and path and is judged as it stands.  Repeated rows stay.
    Columns of the given result names are replaced.
    """
    made = ("host", "path", "rule", "block_score", "verdict")
    pages = pages.drop(*[c for c in made if c != url])
    pattern, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = (
        pages.withColumn("host", host_of(F.col(url)))
        .withColumn("path", path_of(F.col(url)))
        .withColumn("rule", pattern)
        .withColumn("verdict", verdict)
    )
    labelled = ruled.where("rule is not null").select(
        F.col(url).alias("url"), (F.col("verdict") == "block").cast("int").alias("label")
    )
    model = fit(labelled, sample_rows=sample_rows)
    scored = predict(ruled, model, url)
    judged = F.when(F.col("block_score") > threshold, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("verdict", judged))
