"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find spans that are kept in any case. Wider patterns find candidates:
spelled-out addresses, telephone numbers without the international sign in American, German, French
and Spanish groups, card numbers in groups that fail the check digit, IPv6 addresses and those with
dots written out or in brackets. Labelers of three sorts (forms, gazetteers, words around the span)
vote on every span, base or candidate; expectation-maximisation (``weak``) estimates
their reliabilities, and its posteriors train a final classifier, a logistic regression over
the properties of a span, which decides on the candidates.

Kinds are numbered in the order of ``KINDS``; offsets count code points. A null text is an empty one
with no spans; repeated rows are treated alike; an empty table gives no rows. No text and no
number of spans is capped: positions come from prefix sums over the spans of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import table
from corpuslab.llm.weak import fit_votes
from corpuslab.session import staged

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that no run of characters is tried from each of its places: a
# match begins where its run begins or where the match before it ended (\G).
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
#: what a text must have for a pattern to be worth a search
HINT = ("@", r"[0-9]\.[0-9]", r"[0-9](?:[ -]?[0-9]){13}", r"\+[0-9]")
WIDER = (
    r"(?<![\p{L}0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}"
    r"(?:(?: \. |\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?)[A-Za-z0-9-]{1,62}[A-Za-z0-9]){1,4}"
    r"| (?i:at|arobase|arroba) [A-Za-z0-9-]{1,63}(?: (?i:dot|punkt|point|punto) [A-Za-z0-9-]{1,62}[A-Za-z0-9]){1,4})",
    r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?[\[\(]dot[\]\)] ?| dot |\.)[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
    r"|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:]))",
    r"(?<![0-9.-])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{2,4}(?![0-9])",
    r"(?<![0-9+])(?<![0-9][.-])(?:(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}"
    r"|0[0-9](?:[ .-][0-9]{2}){4}"
    r"|(?:\(0[0-9]{1,4}\) ?|0[0-9]{1,4}(?:[ .-]| ?/ ?))(?:[0-9]{5,8}|[0-9]{2,4}(?:[ .-][0-9]{2,5}){1,3})"
    r"|[6-9][0-9]{2}(?:[ .-][0-9]{3}){2}|[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}"
    r"|9[0-9][ .-][0-9]{3}(?:[ .-][0-9]{2}){2})(?![0-9]|[.-][0-9])",
)
WIDER_HINT = (
    r"[\(\[\{]at[\)\]\}]| (?i:dot|punkt|point|punto) ",
    r"[0-9] ?[\[\(](?:\.|dot)[\]\)]|[0-9] dot [0-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]",
    r"[0-9]{4}[ -][0-9]{4}", r"[0-9]\)?(?:[ .-]| ?/ ?)[0-9]{2}")
# fixed values: words that stand near personal data of each kind, and words that deny it
NEAR = (
    r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel|adresse?|address)\b",
    r"(?i)\b(?:ip|host|server|address|adresse|login|client|proxy|from)\b",
    r"(?i)\b(?:card|visa|mastercard|credit|debit|karte|carte|tarjeta|pay(?:ment)?|cc)\b",
    r"(?i)\b(?:tel|phone|call|fax|mobile|cell|whatsapp|telefon|téléphone|teléfono|contact)\b",
)
DENIED = r"(?i)\b(?:version|isbn|issn|order|invoice|serial|section|example|sku|part)\b[ :#.]*$"
TOP_DOMAINS = r"(?i)(?:\.|dot[\)\]\}] ?| (?:dot|punkt|point|punto) )(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl|us)$"
RULES = ("form", "gazetteer", "near", "denied", "check", "plain")
BLOCK = 512
CONTEXT = 40


def prefix_sums(values: Column) -> Column:
    """Sums before each element (and after the last), in blocks, hence about linear."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    zero = F.lit(0).cast("long")

    def running(part: Column, start: Column) -> Column:
        return F.aggregate(
            part, F.array(start),
            lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x))
    starts = running(totals, zero)
    return F.flatten(F.transform(
        blocks, lambda b, i: F.slice(running(b, F.get(starts, i)), 1, F.size(b))))


def located(text: Column, pattern: str, hint: str) -> Column:
    """All matches as ``array<struct<start, end, value>>``; empty without the hint."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(
        matches, F.slice(between, F.lit(1), F.size(matches)),
        lambda m, p: (F.length(p) + F.length(m)).cast("long"))
    spans = F.transform(
        F.arrays_zip(matches.alias("m"), prefix_sums(steps).alias("before"),
                     F.slice(between, F.lit(1), F.size(matches)).alias("p")),
        lambda e: F.struct(
            (e["before"] + F.length(e["p"])).alias("start"),
            (e["before"] + F.length(e["p"]) + F.length(e["m"])).alias("end"),
            e["m"].alias("value")))
    empty = F.expr("cast(array() as array<struct<start: bigint, end: bigint, value: string>>)")
    return F.when(text.rlike(hint), spans).otherwise(empty)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the check digit of a number of at most 19 digits is right."""
    backward = F.reverse(digits(value))

    def step(i: Column) -> Column:
        digit = F.substring(backward, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.length(backward)), step), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def octets(value: Column) -> Column:
    """Whether all parts of a dotted number are at most 255."""
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(value, r"\."), small)


def holds(kind: int, value: Column) -> Column:
    """The condition on a base match."""
    many = F.length(digits(value))
    return (
        F.lit(True),
        octets(value),
        F.when(many.between(14, 19), luhn(value)).otherwise(False),
        many.between(10, 15),
    )[kind]


def judged(text: Column, spans: Column, kind: int, base: bool) -> Column:
    """The votes of all labelers on the spans of one kind, with their places."""
    def vote(good: Column, bad: Column | None = None) -> Column:
        out = F.when(good, 1)
        return (out if bad is None else out.when(bad, -1)).otherwise(0).cast("int")

    def label(e: Column) -> Column:
        value = e["value"]
        # Spark counts code points from 1; the words before and after the span
        left = F.substring(
            text, F.greatest(F.lit(0), e["start"] - CONTEXT).cast("int") + 1,
            F.least(e["start"], F.lit(CONTEXT)).cast("int"))
        right = F.substring(text, e["end"].cast("int") + 1, F.lit(CONTEXT // 2))
        number = digits(value)
        gazetteer = (
            vote(value.rlike(TOP_DOMAINS), ~value.rlike(r"\.[A-Za-z]{2,}$")),
            vote(value.rlike(r"^(?!0\.|255\.)"), value.rlike(r"^0\.")),
            vote(number.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"), number.rlike("^0")),
            vote(value.rlike(r"^\+(?:1|3[0-9]|4[0-9])|^\(?[2-9]|^\(?0[1-9]"), number.rlike("^0{3}")),
        )[kind]
        form = (
            vote(value.rlike(r"^[^@]{1,64}@[^@]{3,}$"), value.rlike(r"\.\.")),
            vote(F.length(value).between(7, 15)),
            vote(F.length(number).isin(15, 16)),
            vote(F.length(number).between(10, 13)),
        )[kind]
        return F.struct(
            F.lit(kind).alias("kind"), e["start"].alias("start"), e["end"].alias("end"),
            F.lit(base).alias("base"), form.alias("form"), gazetteer.alias("gazetteer"),
            vote(F.concat(left, F.lit(" "), right).rlike(NEAR[kind])).alias("near"),
            F.when(left.rlike(DENIED), -1).otherwise(0).cast("int").alias("denied"),
            (F.when(luhn(value), 1).otherwise(-1) if kind == 2 and not base
             else F.lit(1 if base else 0)).cast("int").alias("check"),
            # a number repeated digit by digit, or a span inside a longer word, is no person's
            vote(F.lit(False), number.rlike(r"^(\d)\1+$") | left.rlike(r"[\p{L}0-9_]$")
                 ).alias("plain"))

    return F.transform(spans, label)


def _holding(matches: str, kind: int) -> Column:
    return F.filter(matches, lambda e: holds(kind, e["value"]))


def _of_kind(spans: str, kind: int) -> Column:
    return F.filter(spans, lambda e: e["kind"] == kind)


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_spans``: base spans and candidates of all kinds with their votes."""
    plain = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_t", plain)
    for kind, name in enumerate(KINDS):
        found = located(F.col("_t"), BASE[kind], HINT[kind])
        out = out.withColumn(f"_m{kind}", found)
        out = out.withColumn(f"_b{kind}", _holding(f"_m{kind}", kind))
    parts = [judged(F.col("_t"), F.col(f"_b{k}"), k, True) for k in range(len(KINDS))]
    out = out.withColumn("_base", F.concat(*parts))
    for kind, pattern in enumerate(WIDER):
        out = out.withColumn(f"_w{kind}", located(F.col("_t"), pattern, WIDER_HINT[kind]))
        clear = F.filter(f"_w{kind}", lambda e: ~F.exists(
            "_base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
        out = out.withColumn(f"_c{kind}", judged(F.col("_t"), clear, kind, False))
    added = [F.col(f"_c{k}") for k in range(len(WIDER))]
    return out.select(*docs.columns, F.concat("_base", *added).alias("_spans"))


def train_classifier(spans: DataFrame, target: Column, rounds: int = 30, rate: float = 2.0):
    """Logistic regression of the posterior on properties of a span, seen ``_times``.

    The training table has one row for each combination of discrete properties, however many
    spans there are; each round is one aggregate over it. Returns a function from a
    span to its probability.
    """
    def inputs(e) -> list[Column]:
        kinds = [(e["kind"] == k).cast("double") for k in range(len(KINDS))]
        rules = [e[r].cast("double") for r in RULES]
        return [*kinds, *rules]

    combos = staged(
        spans.groupBy("kind", *RULES).agg(
            F.sum(target * F.col("_times")).alias("_y"),
            F.sum("_times").cast("double").alias("_n")).coalesce(1),
        "span-kinds")
    columns = inputs({c: F.col(c) for c in ("kind", *RULES)})
    weights = [0.0] * len(columns)
    total = float(combos.agg(F.sum("_n")).first()[0] or 0)
    for _ in range(rounds if total else 0):
        odds = sum((c * w for c, w in zip(columns, weights)), F.lit(0.0))
        error = F.col("_y") - F.col("_n") / (1 + F.exp(-odds))
        slopes = combos.agg(*[F.sum(error * c) for c in columns]).first()
        weights = [w + rate * (s / total - 1e-4 * w) for w, s in zip(weights, slopes)]

    def probability(e) -> Column:
        odds = sum((c * float(w) for c, w in zip(inputs(e), weights)), F.lit(0.0))
        return 1 / (1 + F.exp(-odds))

    return probability


def personal_data(docs: DataFrame, text: str = "text", threshold: float = 0.5,
                  out: str = "spans", keep_text: bool = False) -> DataFrame:
    """Add ``out``: accepted spans by start and kind; the text is dropped unless kept."""
    keep = [c for c in docs.columns if c not in (text, out)]
    found = find_spans(docs.select(*keep, text), text)
    if keep_text:  # texts are not written again; the search for spans runs twice instead
        every = found.select(F.explode("_spans").alias("s")).select("s.*")
        every = staged(every.groupBy("kind", *RULES).agg(F.count(F.lit(1)).alias("_times")), "votes")
    else:
        found = staged(found.drop(text), "spans")
        every = found.select(F.explode("_spans").alias("s")).select("s.*").groupBy(
            "kind", *RULES).agg(F.count(F.lit(1)).alias("_times"))
    model = fit_votes(every, RULES, times="_times")
    accept = train_classifier(every, model.posterior())
    chosen = F.filter("_spans", lambda e: e["base"] | (accept(e) >= threshold))
    return found.withColumn(out, F.sort_array(F.transform(chosen, lambda e: F.struct(
        e["start"].alias("start"), e["kind"].alias("kind"), e["end"].alias("end"),
        e["base"].alias("base"))))).drop("_spans")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda e: F.concat_ws(
        ":", F.get(names, e["kind"]), e["start"], e["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    kind_of = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    place = lambda e: F.struct(
        e["start"].alias("start"), e["end"].alias("end"), e["kind"].alias("kind"))
    merged = F.aggregate(
        F.transform(spans, place),
        F.expr("cast(array() as array<struct<start: bigint, end: bigint, kind: int>>)"),
        lambda acc, e: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > e["start"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["start"].alias("start"),
                F.greatest(F.element_at(acc, -1)["end"], e["end"]).alias("end"),
                F.element_at(acc, -1)["kind"].alias("kind"))))
        ).otherwise(F.concat(acc, F.array(e))))
    with_last = lambda m: F.concat(
        F.array_join(F.transform(m, lambda e, i: F.concat(
            F.substring(text, _after(m, i).cast("int") + 1,
                        (e["start"] - _after(m, i)).cast("int")),
            F.get(kind_of, e["kind"]))), ""),
        F.substring(text, F.element_at(m, -1)["end"].cast("int") + 1, F.length(text)))
    return F.when(F.size(spans) > 0, with_last(merged)).otherwise(text)


def _after(merged: Column, i: Column) -> Column:
    return F.coalesce(F.get(merged, i - 1)["end"], F.lit(0).cast("long"))


def op6_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = found.withColumn("_base", F.filter("spans", lambda e: e["base"]))
    many = [
        F.size(_of_kind("_base", k)).cast("long").alias(f"n_{name}")
        for k, name in enumerate(KINDS)]
    return base.select(
        "doc_id", *many, F.sha2(written(F.col("_base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"))
