"""Secret scans: a random forest sorts the false positives out of what looks like a secret.

Candidates are long unbroken strings of the characters keys are made of. Findings that formats decide
are the labelled ones: known key formats next to a word such as ``token`` are right; strings of plain
words, paths, names that a value is assigned to and strings without variety are wrong. The forest learns from those and judges all.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtflow.llm.candidates import count, matches, scored, share, trained
from rtflow.llm.common import kept, names_besides, text_of

#: What a candidate looks like: ``=`` ends one as padding, and stands before one as in ``NAME=value``.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:={1,2}+(?![\"'`]?[A-Za-z0-9+/=_-]))?+"
#: Published formats of keys, and words that stand before one.
FORMATS = (
    "^(?:AKIA|ASIA)[0-9A-Z]{16}$",
    "^gh[pousr]_[A-Za-z0-9]{36,}$",
    "^xox[abprs]-[A-Za-z0-9-]{10,}$",
    "^sk_live_[A-Za-z0-9]{16,}$",
    "^AIza[0-9A-Za-z_-]{35}$",
    "^[0-9a-f]{32}$",
    "^[0-9a-f]{40}$",
    "^[0-9a-f]{64}$",
)
NEIGHBOURS = ("token", "secret", "passw", "pwd", "api.?key", "apikey", "auth", "credential", "private.?key", "access.?key")
#: Words that candidates of no interest are put together from.
DICTIONARY = (
    "example", "sample", "test", "config", "default", "index", "image", "static", "assets", "upload", "content",
    "version", "release", "build", "module", "package", "service", "server", "client", "public", "source", "target",
    "document", "page", "article", "download", "version", "update", "number", "value", "string", "object", "function",
)
SAMPLE, THRESHOLD = 4000, 0.5
FEATURES = [
    "n_chars", "digit_share", "upper_share", "lower_share", "other_share", "hex", "changes", "variety", "vowels",
    "longest_word", "dictionary", "slashes", "after_path", "after_word", "quoted", "assigned", "named",
]


def _features(rows: DataFrame) -> DataFrame:
    said, before = F.col("said"), F.lower("before")
    n = F.greatest(F.length(said), F.lit(1))
    # A character's kind next to another kind's: words change seldom, keys often.
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(said, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    runs = count(kinds, "0+|a+|A+|[^0aA]+")
    words = F.regexp_extract_all(F.lower(said), F.lit("[a-z]+"), F.lit(0))
    longest = F.aggregate(words, F.lit(0), lambda m, w: F.greatest(m, F.length(w)))
    covered = n - F.length(F.regexp_replace(F.lower(said), "|".join(DICTIONARY), ""))
    return rows.withColumns(
        {
            "n_chars": F.length(said),
            "digit_share": share(said, "[0-9]"),
            "upper_share": share(said, "[A-Z]"),
            "lower_share": share(said, "[a-z]"),
            "other_share": share(said, "[^0-9A-Za-z]"),
            "hex": F.rlike(said, F.lit("^[0-9a-fA-F]+$")).cast("double"),
            "changes": (runs - 1) / n,
            "variety": F.size(F.array_distinct(F.split(said, ""))) / F.least(n, F.lit(40)),
            "vowels": share(F.lower(said), "[aeiou]"),
            "longest_word": longest / n,
            "dictionary": covered / n,
            "slashes": count(said, "/"),
            "after_path": F.rlike(before, F.lit(r"(?:https?:|www\.|[/\\.]$|/\S*$)")).cast("double"),
            "after_word": F.rlike(before, F.lit("|".join(NEIGHBOURS))).cast("double"),
            "quoted": F.rlike(before, F.lit("[\"'`]$")).cast("double"),
            "assigned": F.rlike(before, F.lit(r"[=:]\s*[\"'`]?$")).cast("double"),
            # What a value is assigned to: an equals sign that pads a key is in the key.
            "named": F.rlike("after", F.lit(r"^\s{0,3}=")).cast("double"),
        }
    )


def _label() -> Column:
    """1 and 0 where formats decide, else null."""
    known = F.rlike("said", F.lit("|".join(FORMATS))) & (F.col("after_word") == 1)
    plain = (F.col("digit_share") == 0) & (F.col("changes") < 0.2)
    poor = F.col("variety") < 0.2
    return F.when(known, 1).when(plain | poor | (F.col("after_path") == 1) | (F.col("named") == 1), 0)


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without ``text``, with ``n_candidates``, ``secrets`` and ``score`` in place of columns so called.

    ``secrets`` are ``{start, end, p}`` in code points, end exclusive, sorted; ``score`` is the
    greatest probability of a candidate, 0 if there is none. A null or empty text has no candidates.
    Without labelled findings of both kinds, those of a known format next to a word for secrets
    stand, with probability 1.
    """
    rid = F.monotonically_increasing_id().alias("rid_")
    others = names_besides(docs.columns, ("text", "n_candidates", "secrets", "score"))
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0))
    table = kept(docs.select(rid, row.alias("row_"), matches(text_of(), CANDIDATE, across=True).alias("found")))
    rows = kept(_features(table.select("rid_", F.inline("found"))).withColumn("label", _label()))
    model = trained(RandomForestClassifier(numTrees=20, maxDepth=6, seed=5), rows, FEATURES, SAMPLE)
    judged = scored(model, rows, FEATURES) if model else rows.withColumn("p", F.coalesce(F.col("label"), F.lit(0)).cast("double"))
    one = F.struct("start", "end", "p")
    by = judged.groupBy("rid_").agg(
        F.sort_array(F.collect_list(F.when(F.col("p") >= threshold, one))).alias("secrets"), F.max("p").alias("score")
    )
    whole = table.select("rid_", "row_", F.size("found").cast("bigint").alias("n_candidates")).join(by, "rid_", "left")
    none = F.array().cast("array<struct<start:int,end:int,p:double>>")
    return whole.select(*[F.col(f"row_.`{c}`") for c in others], "n_candidates", F.coalesce("secrets", none).alias("secrets"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op6_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents: how many, where, and the best candidate's score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs)
    place = F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id", "n_candidates", F.size("secrets").cast("bigint").alias("n_secrets"), F.array_join(place, ",").alias("spans"), "score"
    )
