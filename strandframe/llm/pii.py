"""Personal data by weak supervision, in DataFrame functions only.

Every kind has a base pattern, whose valid matches are always kept, and a wider
pattern for other writings.  Three labelers vote on each candidate: the pattern
with its checks (regex), lists of domains, issuers and formats (gazetteer), and
the words and characters around it (context).  Expectation-maximisation estimates
how reliable each labeler is without any label, from the counts of vote patterns;
its posterior trains a logistic span classifier over votes and length, and what
that classifier accepts is added to the base spans.

Only counts per vote pattern reach the driver: at most ``4 kinds * 27 votes * 2
origins * 4 lengths`` rows, whatever the corpus.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.shared import let, written

KINDS = ("email", "ip", "card", "phone")

# Base patterns in a form that matches the same spans in linear time: runs are
# possessive, and a match begins where its first run begins.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Other writings: spelt-out mail signs, addresses of eight groups, groups of card
# digits, and national numbers.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?<!\+[0-9 ().-]{1,12})(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.-]?[0-9])",
}
# Gazetteer entries and context words.
MAIL_ENDS = "com org net edu gov mil int info biz io dev app ai co uk us ca au de fr es it nl be ch at pt pl ru cn jp in br eu".split()
NEAR = {
    "email": "mail email e-mail contact write reach correo courriel contacto kontakt".split(),
    "ip": "ip host server address addr network dirección adresse".split(),
    "card": "card visa mastercard amex credit debit payment tarjeta carte karte".split(),
    "phone": "phone call tel telephone mobile cell fax whatsapp teléfono téléphone telefon".split(),
}
AGAINST = "token password key sha md5 hash uuid isbn version commit id order".split()
CONTEXT = 40  # characters looked at before a candidate
FOR, NONE, OPPOSED = 1, 0, 2
ROUNDS = 60
# What is expected of a labeler before any data, by truth: shares of the votes none, for and opposed.
EXPECTED = (
    {"checked": (0.38, 0.02, 0.60), "gazetteer": (0.60, 0.20, 0.20), "context": (0.60, 0.05, 0.35)},
    {"checked": (0.09, 0.90, 0.01), "gazetteer": (0.25, 0.70, 0.05), "context": (0.60, 0.35, 0.05)},
)
PRIOR_SHARE = 0.1  # weight of that expectation, as a share of the candidates


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """The check a base match has to pass."""
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(short(p).try_cast("int"), F.lit(0)) <= 255))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>``: leftmost non-overlapping matches, in code points, end exclusive.

    The text between matches and the matches alternate, so places are running sums
    of their lengths; the sums are kept in blocks, which keeps the fold near linear.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(gaps, found, lambda g, v: F.struct(F.length(g).cast("long").alias("gap"), v.alias("value")))
    span = "array<struct<start:bigint,end:bigint,value:string>>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("block"), F.array().cast(f"array<{span}>").alias("done"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        full = F.size(acc["block"]) >= 256
        item = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(full, item).otherwise(F.concat(acc["block"], item)).alias("block"),
                        F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"]).alias("done"))

    spans = F.aggregate(F.filter(both, lambda x: x["value"].isNotNull()), zero, step,
                        lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["block"]))))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(span))


def _gazetteer(kind: str, value: Column) -> Column:
    if kind == "email":
        end = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
        return F.when(end.isin(MAIL_ENDS), FOR).when(end.rlike("^[0-9]+$"), OPPOSED).otherwise(NONE)
    if kind == "ip":
        head = F.regexp_extract(value, r"^0*([0-9]{1,3})\.", 1).try_cast("int")
        return F.when(head.between(1, 254), FOR).when(head.isNull(), NONE).otherwise(OPPOSED)
    if kind == "card":
        digits = _digits(value)
        issuer = digits.rlike("^(4[0-9]{12}([0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(011|5[0-9]{2})[0-9]{12})$")
        return F.when(issuer, FOR).when(digits.rlike("^0"), OPPOSED).otherwise(NONE)
    plain = _digits(value)
    return F.when(value.rlike(r"^\+?[0-9]{0,3} ?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}$"), FOR).when(plain.rlike(r"^(.)\1+$"), OPPOSED).otherwise(NONE)


def _context(kind: str, before: Column, after: Column) -> Column:
    words = lambda w: r"(?i)(?:^|[^\p{L}])(?:" + "|".join(w) + r")[^\p{L}]"
    inside = before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]")
    return (F.when(inside | before.rlike(words(AGAINST)), OPPOSED).when(before.rlike(words(NEAR[kind])), FOR).otherwise(NONE))


def candidates(text: Column) -> Column:
    """``array<struct<kind, start, end, base, checked, gazetteer, context, size>>`` of a text.

    Candidates are the matches of the base patterns, valid or not, and those of the
    wide patterns that overlap no base match of their kind.
    """
    return let(F.coalesce(text, F.lit("")), _candidates)


def _candidates(body: Column) -> Column:
    lists = []
    for k, kind in enumerate(KINDS):

        def described(x, wide: bool, kind=kind, k=k):
            start = x["start"].cast("int")
            before = F.substring(body, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT)))
            after = F.substring(body, x["end"].cast("int") + 1, F.lit(1))
            checked = F.lit(False) if wide else valid(kind, x["value"])
            return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(not wide).alias("base"),
                            F.when(checked, FOR).otherwise(NONE if wide else OPPOSED).alias("checked"),
                            _gazetteer(kind, x["value"]).alias("gazetteer"), _context(kind, before, after).alias("context"),
                            F.least(F.length(x["value"]) / 8, F.lit(3)).cast("int").alias("size"))

        # a base match far too short to be one (most are single numbers) is no candidate
        least = {"email": 1, "ip": 1, "card": 8, "phone": 7}[kind]
        long_enough = F.filter(matches(body, BASE[kind]), lambda x: x["end"] - x["start"] >= least)
        lists.append(F.transform(long_enough, lambda x: described(x, False)))
        lists.append(F.transform(matches(body, WIDE[kind]), lambda x: described(x, True)))
    return F.concat(*lists)


def is_base(c: Column) -> Column:
    return c["base"] & (c["checked"] == FOR)


FEATURES = ("checked", "gazetteer", "context")


def learn(counts: list[tuple[tuple[int, ...], int]]) -> dict:
    """Weights of the span classifier from ``((kind, base, checked, gazetteer, context, size), n)``.

    Expectation-maximisation per kind: a candidate is personal data or not, and each
    labeler votes with its own probabilities under either.  The start takes the
    majority of votes; counts are smoothed, so no labeler becomes certain.
    """
    posterior = {}
    reliabilities = {}
    for kind in range(len(KINDS)):
        own = [(p, n) for p, n in counts if p[0] == kind]
        if not own:
            continue
        belief = {}
        for p, _ in own:
            votes = [p[2], p[3], p[4]]
            belief[p] = min(0.95, max(0.05, 0.5 + 0.3 * (votes.count(FOR) - votes.count(OPPOSED))))
        for _ in range(ROUNDS):
            mass = [1.0, 1.0]
            strength = 1 + PRIOR_SHARE * sum(n for _, n in own)
            tally = [[[strength * x for x in EXPECTED[truth][f]] for f in FEATURES] for truth in range(2)]
            for p, n in own:
                for truth, b in ((1, belief[p]), (0, 1 - belief[p])):
                    mass[truth] += n * b
                    for f in range(3):
                        tally[truth][f][p[2 + f]] += n * b
            rate = [[[v / sum(t) for v in t] for t in tally[truth]] for truth in range(2)]
            for p, _ in own:
                odds = math.log(mass[1] / mass[0]) + sum(math.log(rate[1][f][p[2 + f]] / rate[0][f][p[2 + f]]) for f in range(3))
                belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        posterior.update(belief)
        reliabilities[KINDS[kind]] = rate
    return {"weights": _logistic([(p, n, posterior[p]) for p, n in counts]), "reliabilities": reliabilities}


def _active(p: tuple[int, ...]) -> list[tuple]:
    """Features of a pattern that are on: kind, each vote of that kind, and its length class."""
    kind, _, *votes, size = p
    return [("kind", kind), ("size", kind, size)] + [(name, kind, v) for name, v in zip(FEATURES, votes)]


def _logistic(rows: list[tuple[tuple[int, ...], int, float]], passes: int = 300) -> dict[tuple, float]:
    """Logistic regression on soft labels, one coordinate at a time; patterns weigh by the root of their number."""
    weights: dict[tuple, float] = defaultdict(float)
    for _ in range(passes):
        gradient, curve = defaultdict(float), defaultdict(float)
        for p, n, target in rows:
            on = _active(p)
            prob = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in on)))))
            for f in on:
                gradient[f] += math.sqrt(n) * (target - prob)
                curve[f] += math.sqrt(n) * 0.25
        for f in gradient:
            weights[f] += (gradient[f] - 0.01 * weights[f]) / (len(FEATURES) + 2) / (curve[f] + 0.01)
    return dict(weights)


def accepted(c: Column, weights: dict[tuple, float]) -> Column:
    """The classifier's verdict on a candidate: probability of at least a half."""
    total = F.lit(0.0)
    for (name, kind, *value), w in sorted(weights.items(), key=str):
        on = c["kind"] == kind
        if value:
            on = on & (c[name] == value[0])
        total = total + F.when(on, F.lit(float(w))).otherwise(0.0)
    return total >= 0


def vote_counts(found: DataFrame, column: str = "_spans") -> list[tuple[tuple[int, ...], int]]:
    names = ["kind", "base", *FEATURES, "size"]
    grouped = found.select(F.explode(column).alias("c")).groupBy(*[F.col(f"c.{n}").alias(n) for n in names]).agg(F.count(F.lit(1)).alias("n"))
    return sorted((tuple(int(r[n]) for n in names), r["n"]) for r in grouped.collect())


def chosen(column: Column, weights: dict[tuple, float]) -> Column:
    """Base spans and accepted others, by start, then kind, as ``array<struct<start, kind, end, base>>``."""
    kept = F.filter(column, lambda c: is_base(c) | accepted(c, weights)) if weights else F.filter(column, is_base)
    return F.array_sort(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"),
                                                             is_base(c).alias("base"))))


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row.

    NULL and empty texts have no spans.  Repeated rows and NULL keys are returned as
    they come; other columns are ignored.  The candidates (places and votes, no text)
    are written once: training and output read the same rows.
    """
    found = written(docs.select(F.col(key).alias(key), candidates(F.col(text)).alias("_spans")), "candidates")
    weights = learn(vote_counts(found))["weights"]
    spans = found.select(key, chosen(F.col("_spans"), weights).alias("_spans"))
    base = F.filter("_spans", lambda s: s["base"])

    def number(k: int) -> Column:
        return F.size(F.filter("_spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")

    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select(key, *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"))


def masked(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets.

    Overlapping spans are replaced once, under the kind of the first.  ``length``
    names a column to hold the new length; all other columns stay, also a NULL text.
    """
    found = docs.select(candidates(F.col(text)).alias("_spans"))
    weights = learn(vote_counts(written(found, "candidates")))["weights"]
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(body, acc, s):
        piece = F.array(F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.element_at(names, s["kind"] + 1))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["parts"], piece)).otherwise(acc["parts"]).alias("parts"))

    def replaced(body):
        return F.aggregate(chosen(_candidates(body), weights), zero, lambda acc, s: step(body, acc, s),
                           lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))))

    out = docs.withColumn(text, F.when(F.col(text).isNotNull(), let(F.col(text), replaced)))
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length and length in docs.columns else out
