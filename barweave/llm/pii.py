"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation estimates how
reliable they are, and a span classifier trained on its posteriors decides. DataFrame functions only; what
comes to the driver are counts of vote patterns, at most a few thousand rows whatever the input."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the classifier may add.
MORE_KINDS = ("ssn", "iban", "person")
KINDS = BASE_KINDS + MORE_KINDS

#: Gazetteers.
TOP_DOMAINS = "com org net edu gov mil int info io co de fr es it uk us nl eu ch at be pl se no dk fi pt ru cn jp in br au ca mx ie nz za kr tr gr cz ro hu ua il sg hk ar cl app dev biz me tv".split()
DIAL_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420".split()
IBAN_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Don Doña Sr Sra".split()
GIVEN_NAMES = "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony Betty Mark Sandra Paul Emily Hans Peter Klaus Jürgen Stefan Ursula Petra Sabine Monika Jean Pierre Michel Jacques Marie Sophie Isabelle Nathalie José Antonio Manuel Francisco Carmen Ana Luis Pedro Lucía Javier".split()
SURNAMES = "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez wilson anderson taylor thomas moore jackson martin lee thompson white harris clark ramirez lewis robinson walker young allen king wright scott hill flores green adams baker hall rivera nelson carter mitchell roberts turner phillips campbell parker evans edwards collins stewart morris murphy cook rogers müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch richter klein wolf neumann schwarz zimmermann braun dubois bernard durand moreau petit leroy roux fournier girard bonnet lefebvre mercier lopez gonzalez perez sanchez fernandez gomez diaz torres ruiz jimenez alvarez romero navarro".split()
CONTEXT = "mail|e-mail|contact|write to|call|tel|phone|fax|mobile|card|visa|mastercard|payment|iban|account|bank|ssn|social security|passport|born|address|name|server|host|login|ip"
AGAINST = "version|build|release|isbn|issn|sku|order no|invoice|serial|model|figure|section|chapter|patent"

#: Possessive groups run as loops in Java, so long runs take no stack; the look-behinds only bar starts in the
#: middle of a run that already failed at its start. A card is a run of 14 digits or more: shorter ones never count.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "person": r"(?<![\p{L}\p{N}])(?=\p{Lu})(?:(?:" + "|".join(TITLES) + r")\.?|" + "|".join(GIVEN_NAMES) + r")\x20\p{Lu}[\p{L}'-]++",
}
#: A text without this has no match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){13}", "phone": r"\+", "ssn": "[0-9]-[0-9]{2}-[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "person": PATTERNS["person"]}

_MARK, _OTHER = "\ue000", "\ue001"
_FOUND = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
#: Characters before a match that the labeler of contexts reads, back to the match before at most.
CONTEXT_CHARS = 40


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine) -> Column:
    """The running combination of an array's values, by doubling: n log n steps, no array grows by one."""

    def step(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), k)

    def double(s: Column, k: Column) -> Column:
        wider = F.transform(s, lambda x, i: F.when(i >= step(k), combine(x, F.get(s, i - step(k)))).otherwise(x))
        return F.when(F.size(s) > step(k), wider).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(29)), values, double)


def matches(text: str, kind: str) -> Column:
    """Positions (code points) and texts of the matches of a kind's pattern, the characters before and after each: the
    text is split at marks put around the matches, and the lengths of the pieces are added up."""
    marked = F.regexp_replace(text, F.lit(PATTERNS[kind]), F.lit(f"{_MARK}$0{_MARK}"))
    none = F.array().cast(_FOUND)

    def found(pieces: Column) -> Column:
        def at(ends: Column) -> Column:
            def one(j: Column) -> Column:  # of the pieces, those at odd places are matches
                return F.struct(
                    F.get(ends, j - 1).alias("start"), F.get(ends, j).alias("end"), F.get(pieces, j).alias("text"),
                    F.right(F.get(pieces, j - 1), F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(pieces, j + 1), F.lit(1)).alias("after"),
                )

            return F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), one)

        return F.when(F.size(pieces) > 2, let(running(F.transform(pieces, F.length), lambda x, y: x + y), at)).otherwise(none)

    return F.when(F.regexp_like(text, F.lit(HINTS[kind])), let(F.split(marked, _MARK), found)).otherwise(none)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("[^0-9]"), F.lit(""))


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """Whether a match of a base kind counts."""
    n = F.length(_digits(text))
    if kind == "ip":
        return F.regexp_like(text, F.lit(r"^(?:0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, m: Column) -> Column:
    """The votes of the labelers on a candidate: pattern, gazetteer, context, borders."""
    body = m["text"]
    before = F.lower(m["before"])
    around = F.concat(F.right(m["before"], F.lit(1)), F.lit(" "), m["after"])
    never = F.lit(False)
    if kind == "email":
        listed = F.lower(F.regexp_extract(body, r"\.([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS)
        pattern, gazetteer = _vote(~F.regexp_like(body, F.lit(r"^[.]|\.\.|\.@")), F.regexp_like(body, F.lit(r"\.\."))), _vote(listed, ~listed)
    elif kind == "ip":
        odd = F.regexp_like(body, F.lit(r"^0|\.0[0-9]"))
        pattern, gazetteer = _vote(~odd, odd), _vote(never, F.regexp_like(body, F.lit(r"^(?:0|127|255)\.")))
    elif kind == "card":
        known = F.regexp_like(_digits(body), F.lit("^(?:3[47]|4|5[1-5]|6)"))
        pattern, gazetteer = F.lit(1), _vote(known, ~known)
    elif kind == "phone":
        known = F.regexp_like(body, F.lit(r"^\+(?:" + "|".join(DIAL_CODES) + ")"))
        pattern, gazetteer = F.lit(1), _vote(known, ~known)
    elif kind == "ssn":
        bad = F.regexp_like(body, F.lit("^(?:000|666|9)|-00-|-0000$"))
        pattern, gazetteer = _vote(~bad, bad), F.lit(0)
    elif kind == "iban":
        known = F.substr(body, F.lit(1), F.lit(2)).isin(IBAN_COUNTRIES)
        size = F.length(F.regexp_replace(body, F.lit(" "), F.lit("")))
        pattern, gazetteer = _vote((size >= 15) & (size <= 31), size > 34), _vote(known, ~known)
    else:
        known = F.lower(F.regexp_extract(body, r"([\p{L}'-]+)$", 1)).isin(SURNAMES)
        titled = F.regexp_like(body, F.lit("^(?:" + "|".join(TITLES) + r")\b"))
        pattern, gazetteer = _vote(titled, never), _vote(known, never)
    context = _vote(F.regexp_like(before, F.lit(rf"(?<!\p{{L}})(?:{CONTEXT})(?!\p{{L}})")), F.regexp_like(before, F.lit(rf"(?<!\p{{L}})(?:{AGAINST})(?!\p{{L}})")))
    glued = F.regexp_like(around, F.lit(r"[\p{L}\p{N}@/]"))
    return F.struct(pattern.cast("int").alias("pattern"), gazetteer.cast("int").alias("gazetteer"), context.cast("int").alias("context"), _vote(~glued, glued).cast("int").alias("border"))


LABELERS = ("pattern", "gazetteer", "context", "border")


def _shape(m: Column) -> list[Column]:
    """What the classifier reads of a candidate's own text: the power of two of its length; its digits (none, some,
    half or more, all); what stands right before it (nothing or space, a sign that announces a value, another one)."""
    body = m["text"]
    n, digits = F.length(body), F.length(_digits(body))
    last = F.right(m["before"], F.lit(1))
    size = F.least(F.floor(F.log2(n.cast("double"))).cast("int"), F.lit(7))
    share = F.when(digits == 0, 0).when(2 * digits < n, 1).when(digits < n, 2).otherwise(3)
    lead = F.when(F.regexp_like(last, F.lit(r"^\s?$")), 0).when(F.regexp_like(last, F.lit(r"^[:=(<\"']$")), 1).otherwise(2)
    return [size.alias("size"), share.cast("int").alias("digits"), lead.cast("int").alias("lead")]


def candidates(docs: DataFrame, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """The ``keep`` columns and ``spans``: array of (start, kind, end, size, digits, lead, votes) in order, kind by
    index. ``docs`` has no columns ``spans`` and ``_clean``."""
    clean = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _MARK, _OTHER)  # as long, and in no pattern
    rows = docs.withColumn("_clean", clean)

    def listed(no: int, kind: str) -> Column:
        found = F.filter(matches("_clean", kind), lambda m: valid(kind, m["text"]))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind"), m["end"].alias("end"), *_shape(m), _votes(kind, m).alias("votes")))

    lists = [listed(no, kind) for no, kind in enumerate(KINDS)]
    return rows.select(*keep, F.array_sort(F.concat(*lists)).alias("spans"))


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities of the labelers (probability that a vote for or against is right), weights of the classifier."""

    reliability: dict[str, tuple[float, float]]
    weights: dict[str, float]

    def probability(self, span: Column) -> Column:
        w = self.weights

        def weight(name: str, values, index: Column) -> Column:
            return F.element_at(F.array(*[F.lit(w.get(f"{name}{v}", 0.0)) for v in values]), index)

        score = F.lit(w.get("one", 0.0)) + weight("kind", range(len(KINDS)), span["kind"] + 1) + F.lit(w.get("size", 0.0)) * span["size"]
        score += weight("digits", range(4), span["digits"] + 1) + weight("lead", range(3), span["lead"] + 1)
        for name in LABELERS:
            score += weight(name, (-1, 0, 1), span["votes"][name] + 2)
        return 1 / (1 + F.exp(-score))


#: What the classifier reads besides the votes.
SHAPE = ("kind", "size", "digits", "lead")


def _features(shape: tuple[int, ...], votes: tuple[int, ...]) -> list[tuple[str, float]]:
    kind, size, digits, lead = shape
    return [("one", 1.0), (f"kind{kind}", 1.0), ("size", float(size)), (f"digits{digits}", 1.0), (f"lead{lead}", 1.0), *[(f"{n}{v}", 1.0) for n, v in zip(LABELERS, votes)]]


def expectation_maximisation(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 50) -> tuple[list[float], dict]:
    """``patterns``: kind, votes, count. Posteriors that a span is personal data, in order; for each labeler and
    truth the probabilities of its three votes. Votes are independent given the truth; kinds have own priors."""
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for _, v, _ in patterns]
    table: dict = {}
    for _ in range(rounds):
        prior, total = [1.0] * len(KINDS), [2.0] * len(KINDS)
        table = {(i, y, v): (3.0 if (v == 1) == bool(y) and v else 1.0) for i in range(len(LABELERS)) for y in (0, 1) for v in (-1, 0, 1)}
        for (kind, votes, n), p in zip(patterns, post):
            prior[kind] += n * p
            total[kind] += n
            for i, v in enumerate(votes):
                table[i, 1, v] += n * p
                table[i, 0, v] += n * (1 - p)
        for i in range(len(LABELERS)):
            for y in (0, 1):
                s = sum(table[i, y, v] for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    table[i, y, v] /= s
        now = []
        for kind, votes, _ in patterns:
            share = prior[kind] / total[kind]
            odds = math.log(share / (1 - share)) + sum(math.log(table[i, 1, v] / table[i, 0, v]) for i, v in enumerate(votes))
            now.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        done = max((abs(a - b) for a, b in zip(now, post)), default=0.0) < 1e-6
        post = now
        if done:
            break
    return post, table


def fit_span_model(spans: DataFrame, steps: int = 300) -> SpanModel:
    """Votes are counted by pattern over all candidates; the classifier is a logistic regression on kind, the shape of
    the text and votes, trained on the posteriors, each weighted by the logarithm of its count."""
    keys = [F.col(f"s.{n}").alias(n) for n in SHAPE] + [F.col(f"s.votes.{n}").alias(n) for n in LABELERS]
    counted = spans.select(F.explode("spans").alias("s")).groupBy(*keys).count()
    rows = sorted((tuple(r[n] for n in SHAPE), tuple(r[n] for n in LABELERS), float(r["count"])) for r in counted.collect())
    post, table = expectation_maximisation([(shape[0], v, n) for shape, v, n in rows])
    reliability = {}
    for i, name in enumerate(LABELERS):
        if table:
            share = sum(n * p for (_, _, n), p in zip(rows, post)) / max(1.0, sum(r[2] for r in rows))
            right = [share * table[i, 1, 1], (1 - share) * table[i, 0, -1]]
            wrong = [(1 - share) * table[i, 0, 1], share * table[i, 1, -1]]
            reliability[name] = tuple(r / (r + w) if r + w else 0.5 for r, w in zip(right, wrong))
    weights: dict[str, float] = {}
    cases = [(_features(shape, v), p, math.log1p(n)) for (shape, v, n), p in zip(rows, post)]
    mass = sum(c[2] for c in cases) or 1.0
    for _ in range(steps):
        slope: dict[str, float] = {}
        for features, p, n in cases:
            score = sum(weights.get(f, 0.0) * x for f, x in features)
            gap = n / mass * (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, score)))))
            for f, x in features:
                slope[f] = slope.get(f, 0.0) + gap * x
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) + (0.05 if f == "size" else 1.0) * (g - 1e-3 * weights.get(f, 0.0))
    return SpanModel(reliability, {f: round(w, 6) for f, w in weights.items()})


def kept_spans(model: SpanModel, threshold: float) -> Column:
    """Base spans, and others whose probability is at least ``threshold``."""
    return F.filter("spans", lambda s: (s["kind"] < len(BASE_KINDS)) | (model.probability(s) >= threshold))


def _is_kind(no: int):
    return lambda s: s["kind"] == no


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more (spans that the model added).

    A null text counts as empty. Repeated rows each give a row; a null id is kept; other columns are ignored;
    an empty table gives no rows. Offsets are code points, the end exclusive; texts of any length are taken
    whole, in nearly linear time. Texts are read once; what is written to the shared folder are ids and spans."""
    spans = stored(candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ("doc_id",), "text"))
    model = fit_span_model(spans)
    rows = spans.withColumn("all", kept_spans(model, threshold)).withColumn("base", F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS)))
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_more"))


#: Masking cuts texts in pieces of so many characters, so that a part of a text is found without reading up to it.
CUT = 256


def _part(cuts: Column, start: Column, end: Column) -> Column:
    """The characters of [start, end) of a text in pieces of CUT."""
    first = F.floor(start / CUT).cast("int")
    last = F.floor((end - 1) / CUT).cast("int")
    joined = F.array_join(F.slice(cuts, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(start < end, F.substr(joined, start - first * CUT + 1, end - start)).otherwise(F.lit(""))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each of the spans, at least one, replaced by its kind; in time linear in the text."""
    kinds = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def build(cuts: Column) -> Column:
        def joined(reach: Column) -> Column:
            def one(s: Column, j: Column) -> Column:
                done = F.when(j > 0, F.get(reach, j - 1)).otherwise(0)
                return F.when(s["start"] >= done, F.concat(_part(cuts, done, s["start"]), F.element_at(kinds, s["kind"] + 1))).otherwise(F.lit(""))

            return F.concat(F.array_join(F.transform(spans, one), ""), _part(cuts, F.element_at(reach, -1), F.length(text)))

        return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), joined)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), build)


def mask_personal_data(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets; overlapping spans
    become one, named after the first; a column ``n_chars`` is set to the new length. A null text stays null. Repeated
    rows are masked alike; other columns, whatever their names, are handed on; an empty table gives an empty one. Texts
    are matched once: rows and their spans are written to the shared folder, the model is fitted to the spans."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    text = dict(zip(map(str.lower, docs.columns), names))[text_col.lower()]
    found = stored(candidates(docs.toDF(*names), tuple(names), text))
    rows = found.withColumn("spans", kept_spans(fit_span_model(found), threshold))
    out = rows.withColumn(text, F.when(F.size("spans") > 0, masked(F.col(text).cast("string"), F.col("spans"))).otherwise(F.col(text)))
    length = {n: F.length(text).cast(docs.schema[c].dataType).alias(n) for c, n in zip(docs.columns, names) if c.lower() == "n_chars"}
    return out.select(*[length.get(n, F.col(n)) for n in names]).toDF(*docs.columns)
