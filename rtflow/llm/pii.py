"""Personal data: generators propose overlapping spans, gradient-boosted trees choose among them.

Strict patterns (the base) always stand. Looser patterns propose more: numbers and addresses in other
forms, and what fails the strict checks. Trees learn from candidates that checks decide (those that
share a base span's place are right, those whose check digits or ranges are wrong are not) by format
and context, and judge the others. A threshold for each kind is calibrated on labelled candidates.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtflow.llm.candidates import count, matches, scored, share, trained
from rtflow.llm.common import kept, names_besides, text_of

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that each text is read in linear time: a match begins where no run of
# its characters is going on, or where the match before has ended, which is where a search finds it.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: What the generators propose besides.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
_NEEDS = {"email": ("@", None), "ip": (".", "."), "card": (None, None), "phone": ("+", None)}
#: Labelled candidates to learn from at most; probability classes for the thresholds; least precision.
SAMPLE, CLASSES, PRECISION = 4000, 50, 0.95
FEATURES = [
    "is_email", "is_ip", "is_card", "is_phone", "n_digits", "n_chars", "n_groups", "n_seps", "luhn", "in_range",
    "digit_share", "glued_before", "glued_after", "said_phone", "said_mail", "said_card", "said_ip", "lead",
]


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _holds(kind: str, said: Column) -> Column:
    """The strict check of a match."""
    n = F.length(_digits(said))
    if kind == "ip":
        return F.rlike(said, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        return n.between(14, 19) & F.coalesce(F.call_function("luhn_check", _digits(said)), F.lit(False))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _checked(kind: str):
    return lambda m: _holds(kind, m["said"])


def _as_span(number: int, *names: str):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), *[m[n].alias(n) for n in names])


def base_spans(text: Column) -> Column:
    """An array of ``kind`` (place in ``KINDS``), ``start``, ``end``, in the order start, kind."""
    arrays = []
    for number, kind in enumerate(KINDS):
        found = F.filter(matches(text, BASE[kind], _NEEDS[kind][0]), _checked(kind))
        arrays.append(F.transform(found, _as_span(number, "end")))
    return F.array_sort(F.concat(*arrays))


def proposals(text: Column) -> Column:
    """Candidates of all generators, which may overlap: ``kind, start, end, said, before, after``."""
    arrays = []
    for number, kind in enumerate(KINDS):
        for pattern, needs in ((LOOSE[kind], _NEEDS[kind][1]), (BASE[kind], _NEEDS[kind][0])):
            if kind == "card" and pattern == BASE["card"]:  # any number: only those of a card's length
                pattern = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
            arrays.append(F.transform(matches(text, pattern, needs), _as_span(number, "end", "said", "before", "after")))
    return F.concat(*arrays)


def _features(rows: DataFrame) -> DataFrame:
    said, before = F.col("said"), F.lower("before")
    digits = _digits(said)
    word = lambda *w: F.rlike(before, F.lit("|".join(w))).cast("double")
    out = rows
    for number, kind in enumerate(KINDS):
        out = out.withColumn(f"is_{kind}", (F.col("kind") == number).cast("double"))
    return out.withColumns(
        {
            "n_digits": F.length(digits),
            "n_chars": F.length(said),
            "n_groups": count(said, "[0-9]+"),
            "n_seps": count(said, "[^0-9A-Za-z]"),
            "luhn": F.coalesce(F.call_function("luhn_check", digits), F.lit(False)).cast("double"),
            "in_range": F.rlike(said, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")).cast("double"),
            "digit_share": share(said, "[0-9]"),
            "glued_before": F.rlike(F.right("before", F.lit(1)), F.lit("[0-9A-Za-z.@/-]")).cast("double"),
            "glued_after": F.rlike(F.left("after", F.lit(1)), F.lit("[0-9A-Za-z@/-]")).cast("double"),
            "said_phone": word("phone", "tel", "call", "fax", "mobil"),
            "said_mail": word("mail", "contact", "write"),
            "said_card": word("card", "visa", "pay", "credit"),
            "said_ip": word("ip", "host", "server", "address"),
            "lead": F.coalesce(F.try_to_number(F.left(digits, F.lit(1)), F.lit("9")).cast("double"), F.lit(-1.0)),
        }
    )


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text`` but with ``base`` and ``spans``, arrays of ``{start, kind, end}``, in
    place of columns so called.

    Places are in code points, ends exclusive; ``kind`` is a place in ``KINDS``; arrays are sorted by
    start, kind, end. A null or empty text has none. Repeated rows have their own results. Without
    labelled candidates of both labels nothing is learnt, and ``spans`` are the base.
    """
    rid = F.monotonically_increasing_id().alias("rid_")
    others = names_besides(docs.columns, ("text", "base", "spans"))
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0))
    mine = [F.col(f"row_.`{c}`") for c in others]
    # The texts are read once; the table holds each row's number, so that later steps agree on it.
    table = kept(docs.select(rid, row.alias("row_"), base_spans(text_of()).alias("base"), proposals(text_of()).alias("proposed")))
    hold = F.filter("base", lambda b: (b["kind"] == F.col("c.kind")) & (b["start"] < F.col("c.end")) & (F.col("c.start") < b["end"]))
    rows = table.select("rid_", "base", F.explode("proposed").alias("c"))
    rows = rows.withColumn("based", F.size(hold) > 0).select("rid_", "based", "c.*").distinct()
    rows = kept(_features(rows))
    wrong = F.when(F.col("kind") == 1, F.col("in_range") == 0).when(F.col("kind") == 2, F.col("luhn") == 0)
    wrong = wrong.when(F.col("kind") == 3, ~F.col("n_digits").between(10, 15)).otherwise(False)
    labelled = rows.withColumn("label", F.when(F.col("based"), 1).when(wrong, 0))
    model = trained(GBTClassifier(maxIter=8, maxDepth=3, seed=3), labelled, FEATURES, SAMPLE, ("kind",))
    if model is None:
        return table.select(*mine, "base", F.col("base").alias("spans"))
    judged = kept(scored(model, labelled, FEATURES).select("rid_", "kind", "start", "end", "based", "label", "p"))
    places = F.least(F.floor(F.col("p") * CLASSES), F.lit(CLASSES - 1))
    counts = judged.where("label is not null").groupBy("kind", places.alias("at")).agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("n"))
    thresholds = {}  # at most CLASSES rows for each kind
    for kind in range(len(KINDS)):
        right = all_ = 0
        for row in sorted(counts.where(F.col("kind") == kind).collect(), key=lambda r: -r["at"]):
            right, all_ = right + row["right"], all_ + row["n"]
            if right >= PRECISION * all_:
                thresholds[kind] = row["at"] / CLASSES
    passes = F.lit(False)
    for kind, least in thresholds.items():
        passes = passes | ((F.col("kind") == kind) & (F.col("p") >= least))
    # What overlaps a base span of its kind says nothing new.
    chosen = judged.where(passes & ~F.col("based")).groupBy("rid_").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    whole = table.join(chosen, "rid_", "left")
    # Neither has a span twice, and what is chosen overlaps no base span of its kind.
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return whole.select(*mine, "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column, mark: str = "[redacted]") -> Column:
    """The text with spans (sorted by start) replaced by a mark; overlapping spans share one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        upto = F.substr(text, state["at"] + 1, s["start"] - state["at"])
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], upto, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents: the base by the contract's patterns, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)
    kinds = F.transform("base", lambda b: b["kind"])
    numbers = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("bigint").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *numbers, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
