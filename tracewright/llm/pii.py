"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them.

Candidates are the base kinds (email, ip, card, phone), long runs of letters and digits (``secret``)
and numbers with at least nine digits that no base kind took (``number``). Labelers vote for or
against a candidate, or abstain: regular expressions for its shape, gazetteers for the words just
before it, and its context. Votes of the whole corpus are counted by pattern (a few hundred at most);
expectation-maximisation estimates each labeler's reliability from the counts, and its posteriors
train a logistic classifier over votes and kinds, which decides. Base spans stay in any case.

Only DataFrame expressions run on executors; the driver handles the counts of vote patterns. Null and
empty texts have no spans. Repeated rows are judged each for itself. An empty table gives an empty
result. Input columns are kept; results sit in the one column ``_pii``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

KINDS = ["email", "ip", "card", "phone", "secret", "number"]
BASE = KINDS[:4]

# Each pattern finds what the plain form finds, in linear time: runs are possessive, and a match begins
# where its run begins or where the last match ended.
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+",
    "number": r"(?<![0-9A-Za-z])[0-9]++(?:[\x20.()-]{1,2}+[0-9]++)*+",
}

# Words that announce a credential or a number of a person, in lower case.
CREDENTIAL_WORDS = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "key", "bearer", "auth", "credential"]
NUMBER_WORDS = ["ssn", "phone", "tel", "fax", "mobile", "call", "card", "iban", "account", "passport", "visa"]

LABELERS = ["shape", "gazetteer", "context", "variety", "checksum"]
CONTEXT_CHARS = 24


def _bound(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _prefix_sums(lengths: Column) -> Column:
    """Running sums of an array, in groups, so the cost stays near linear for long arrays."""
    size = 256
    groups = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / size).cast("int"))
    part = lambda g: F.slice(lengths, g * size + 1, F.lit(size))
    zero = F.lit(0).cast("long")
    total = lambda g: F.aggregate(part(g), zero, lambda a, x: a + x)
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    starts = F.aggregate(F.transform(groups, total), F.array(zero), grow)
    within = lambda starts: F.flatten(F.transform(groups, lambda g: F.slice(F.aggregate(part(g), F.array(F.get(starts, g)), grow), F.lit(2), F.lit(size))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(_bound(starts, within))


def _located(text: Column, pattern: str) -> Column:
    """All matches with their places in code points: between matches lie the parts of a split."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    both = F.arrays_zip(matches.alias("m"), parts.alias("p"))

    def places(found: Column) -> Column:
        steps = F.transform(F.filter(found, lambda x: x.m.isNotNull()), lambda x: (F.length(x.p) + F.length(x.m)).cast("long"))
        return _bound(_prefix_sums(steps), lambda ends: F.transform(F.filter(found, lambda x: x.m.isNotNull()), lambda x, i: F.struct((F.get(ends, i) - F.length(x.m)).alias("start"), F.get(ends, i).alias("end"), x.m.alias("m"))))

    return _bound(both, places)


_EMPTY = "array<struct<start:bigint,end:bigint,m:string>>"


def _kind_spans(text: Column, kind: str) -> Column:
    found = _located(text, PATTERNS[kind])
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    cheap = {"email": text.contains("@"), "phone": text.rlike(r"\+[0-9]"), "ip": text.rlike(r"[0-9]\.[0-9]"), "secret": text.rlike(r"[A-Za-z0-9_]{16}"), "number": text.rlike("[0-9]"), "card": text.rlike("[0-9]")}[kind]
    good = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x.m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": lambda x: _bound(digits(x.m), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d)),
        "phone": lambda x: F.length(digits(x.m)).between(9, 15),
        "secret": lambda x: x.m.rlike("[0-9]") & x.m.rlike("[A-Za-z]"),
        "number": lambda x: F.length(digits(x.m)).between(9, 19),
    }[kind]
    return F.when(cheap, F.filter(found, good)).otherwise(F.array().cast(_EMPTY))


def _votes(text: Column, kind: str, x: Column) -> Column:
    """Votes of the labelers on a candidate: 1 for personal data, -1 against, 0 for none."""
    before = F.substr(text, F.greatest(x.start - CONTEXT_CHARS + 1, F.lit(1)).cast("int"), F.least(x.start, F.lit(CONTEXT_CHARS)).cast("int"))
    after = F.substr(text, (x.end + 1).cast("int"), F.lit(2))
    digits = F.regexp_replace(x.m, "[^0-9]", "")
    sign = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    words = lambda names: rf"(?i)(?<![A-Za-z])(?:{'|'.join(names)})(?![A-Za-z])"
    shape = {
        "secret": sign(x.m.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})$"), x.m.rlike("[A-Za-z]{12}") & ~x.m.rlike("[0-9].*[0-9].*[0-9]")),
        "number": sign(x.m.rlike(r"^(?:[0-9]{16}|[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:[0-9]{4}[\x20-]){3}[0-9]{4})$"), x.m.rlike(r"\.[0-9]{1,2}$") | (F.length(digits) > 16)),
    }.get(kind, F.lit(1))
    vocabulary = {"secret": CREDENTIAL_WORDS, "number": NUMBER_WORDS}.get(kind, NUMBER_WORDS + CREDENTIAL_WORDS + ["mail", "email", "contact", "host", "server"])
    opening = {"secret": r"[=:]\s*[\"']?$", "number": r"[:#]\s*$"}.get(kind, r"[:<(=]\s*$")
    variety = F.size(F.array_distinct(F.split(F.lower(x.m), "")))
    return F.array(
        shape,
        sign(before.rlike(words(vocabulary)), F.lit(False)),
        sign(before.rlike(opening), after.rlike(r"^[\w]")),
        sign(variety >= 9, variety <= 4),
        sign(F.lit(kind == "card"), F.lit(kind == "number") & F.length(digits).between(12, 19)),
    )


def candidates(text: Column) -> Column:
    """All candidates of a text: array of kind number, start, end, votes; in order of start and kind."""
    t = F.coalesce(text, F.lit(""))

    def of_kind(t: Column, k: int, kind: str) -> Column:
        voted = lambda x: F.struct(x.start.alias("start"), F.lit(k).alias("kind"), x.end.alias("end"), _votes(t, kind, x).alias("votes"))
        return F.transform(_kind_spans(t, kind), voted)

    def made(t: Column) -> Column:
        lists = [of_kind(t, k, kind) for k, kind in enumerate(KINDS)]
        return _bound(F.concat(*lists[:4]), lambda base: F.array_sort(F.concat(base, F.filter(F.concat(*lists[4:]), lambda c: ~F.exists(base, lambda b: (b.start < c.end) & (c.start < b.end))))))

    return F.when(t.rlike(r"[0-9@]"), _bound(t, made)).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,votes:array<int>>>"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> tuple[list[float], list[dict]]:
    """EM over (kind, votes, count): the posterior of each pattern, and P(vote | class) for each labeler."""
    posterior = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for _, v, _ in patterns]
    model: list[dict] = []
    for _ in range(rounds):
        weight = {c: sum((q if c else 1 - q) * n for q, (_, _, n) in zip(posterior, patterns)) for c in (0, 1)}
        model = []
        for j in range(len(LABELERS)):
            table = {}
            for c in (0, 1):
                for v in (-1, 0, 1):
                    seen = sum((q if c else 1 - q) * n for q, (_, votes, n) in zip(posterior, patterns) if votes[j] == v)
                    prior = 4.0 if (v == 1) == (c == 1) and v else 1.0  # labelers are better than chance
                    table[c, v] = (seen + prior) / (weight[c] + 6.0)
            model.append(table)
        share = (weight[1] + 1) / (weight[0] + weight[1] + 2)
        posterior = []
        for _, votes, _ in patterns:
            log = math.log(share / (1 - share)) + sum(math.log(t[1, v] / t[0, v]) for t, v in zip(model, votes))
            posterior.append(1 / (1 + math.exp(-max(-30.0, min(30.0, log)))))
    return posterior, model


def _features(kind: int, votes: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(v == 1) for v in votes), *(float(v == -1) for v in votes), *(float(kind == k) for k in range(len(KINDS)))]


def classifier(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 400) -> list[float]:
    """Logistic weights over votes and kinds, fitted to the posteriors; patterns weigh by the root of their counts."""
    weights = [0.0] * (1 + 2 * len(LABELERS) + len(KINDS))
    if not patterns:
        return weights
    posterior, _ = reliabilities(patterns)
    rows = [(_features(k, v), q, math.sqrt(n)) for (k, v, n), q in zip(patterns, posterior)]
    total = sum(w for _, _, w in rows)
    for _ in range(rounds):
        slope = [1e-3 * w for w in weights]
        for x, q, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x))))))
            for i, a in enumerate(x):
                if a:
                    slope[i] += (p - q) * n / total
        weights = [w - 2.0 * s for w, s in zip(weights, slope)]
    return weights


def _accepted(weights: list[float], c: Column) -> Column:
    score = F.lit(weights[0])
    m = len(LABELERS)
    for j in range(m):
        vote = F.get(c.votes, j)
        score = score + F.when(vote == 1, weights[1 + j]).when(vote == -1, weights[1 + m + j]).otherwise(0.0)
    for k in range(len(KINDS)):
        score = score + F.when(c.kind == k, weights[1 + 2 * m + k]).otherwise(0.0)
    return (c.kind < len(BASE)) | (score > 0)


def find_pii(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The documents with ``_pii``: spans as structs of start, kind number, end, in order.

    Without keep_text the text column is left out, so that only spans are held in the shared folder. An
    input column of that name gives way to it.
    """
    found = docs.withColumn("_pii", candidates(F.col(text_col)))
    held = written(found if keep_text else found.drop(text_col), "candidates")
    counts = held.select(F.explode("_pii").alias("c")).groupBy("c.kind", "c.votes").agg(F.count(F.lit(1)).alias("n"))
    patterns = sorted((r.kind, tuple(r.votes), r.n) for r in counts.collect())  # at most 6 kinds by 3**5 votes
    weights = classifier(patterns)
    return held.withColumn("_pii", F.transform(F.filter("_pii", lambda c: _accepted(weights, c)), lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end"))))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first, in brackets."""
    name = lambda k: F.element_at(F.array(*(F.lit(f"[{x.upper()}]") for x in KINDS)), k + 1)
    step = lambda acc, s: F.when(s.start >= acc.at, F.struct(s.end.alias("at"), F.concat(acc.done, F.array(F.substr(text, (acc.at + 1).cast("int"), (s.start - acc.at).cast("int")), name(s.kind))).alias("done"))).otherwise(F.struct(F.greatest(acc.at, s.end).alias("at"), acc.done.alias("done")))
    end = lambda acc: F.concat(F.array_join(acc.done, ""), F.substr(text, (acc.at + 1).cast("int")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("done"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, end))
