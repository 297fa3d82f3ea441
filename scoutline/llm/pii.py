"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Base spans (emails, IP addresses, payment cards, phone numbers) are defined by their expressions and always stay. Further
candidates (keys and tokens, account and identity numbers, phone numbers without a plus, handles) are only proposed: three
labelers vote on each: a strict form, a gazetteer of cue words next to the span, and the shape of the surrounding line.
Votes are counted by pattern over the whole corpus; expectation-maximisation on those counts (their number depends on the
labelers, not on the data) estimates how reliable each labeler is, and gives each pattern a posterior. The final classifier
is a naive Bayes model over span and context features, trained on all candidates with their posteriors as soft labels, so
it also decides where no labeler votes.

One scan of the texts writes the candidates; all later steps work on that small table. The driver sees counts of vote
patterns and of features, both bounded by constants. No step groups by document, source or text, so nothing is skewed.

Null and empty texts have no spans. Null ids are carried, repeated rows give repeated results, other columns are ignored.
A corpus without candidates gets a classifier that accepts nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .common import let, only, text_of

# Each expression starts only where a run of its first characters starts, or where the last match ended (\G): elsewhere in
# a run it would fail as it did at the start. That, and possessive repeats, keep long runs linear without changing a match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Proposed kinds -> expression. Forms of identifiers in common use.
PROPOSALS = {
    "secret": r"(?<![A-Za-z0-9_-])(?:[A-Fa-f0-9]{32,}+|(?:sk|pk|ghp|xox[abp])[-_][A-Za-z0-9_-]{16,}+|AKIA[A-Z0-9]{16})(?![A-Za-z0-9_-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+().-])\([0-9]{2,5}\)\x20?[0-9]{3}[\x20-][0-9]{3,4}(?![0-9])",
    "handle": r"(?<![A-Za-z0-9._%+-])@[A-Za-z_][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_@.])",
}
#: Cue words just before a span, in the languages of the corpus, that speak for and against its kind.
CUES = {
    "secret": r"token|secret|password|passwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|bearer|passwort|contrase[nñ]a|mot de passe|clave",
    "account": r"iban|account|konto|compte|cuenta|bank",
    "identity": r"ssn|social security|identity|ausweis|identit[eé]|identidad",
    "local_phone": r"phone|tel|call|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono|anruf",
    "handle": r"twitter|instagram|follow|dm|contact|handle|user",
}
AGAINST = r"sha-?1|sha-?256|md5|commit|checksum|digest|hash|isbn|issn|doi|version|rev|uuid|page|example|media|import"
LEFT, RIGHT = 40, 12  # code points of context
LABELERS = 3
VOTES = ("no", "abstain", "yes")
ROUNDS = 100

SPANS = "array<struct<start:bigint,end:bigint,hit:string>>"


def matches(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<start, end, hit>> of the leftmost non-overlapping matches, in code points, end exclusive."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out"))

    def step(gaps: Column):
        def add(acc: Column, hit: Column) -> Column:
            first = (acc["at"] + F.length(F.get(gaps, acc["i"]))).cast("bigint")
            last = (first + F.length(hit)).cast("bigint")
            return F.struct((acc["i"] + 1).alias("i"), last.alias("at"),
                            F.concat(acc["out"], F.array(F.struct(first.alias("start"), last.alias("end"), hit.alias("hit")))).alias("out"))
        return add

    return let(F.split(text, pattern, -1), lambda gaps: F.aggregate(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), start, step(gaps), lambda acc: acc["out"]))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit doubled, digit sums add up to a multiple of 10."""
    digit = lambda i: F.substring(F.reverse(number), i + 1, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid_ip(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def _valid_card(hit: Column) -> Column:
    return let(digits(hit), lambda d: F.when((F.length(d) >= 13) & (F.length(d) <= 19), luhn(d)).otherwise(False))


def _valid_phone(hit: Column) -> Column:
    return F.length(digits(hit)).between(9, 15)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind. A text without the characters a kind needs is not searched for it."""
    none = F.array().cast(SPANS)
    found = lambda gate, pattern: F.when(gate, matches(text, pattern)).otherwise(none)
    return {
        "email": found(F.contains(text, F.lit("@")), EMAIL),
        "ip": F.filter(found(text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), IP), lambda s: _valid_ip(s["hit"])),
        "card": F.filter(found(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CARD), lambda s: _valid_card(s["hit"])),
        "phone": F.filter(found(F.contains(text, F.lit("+")), PHONE), lambda s: _valid_phone(s["hit"])),
    }


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _strict(kind: str, hit: Column) -> Column:
    """The form labeler: digits and letters mixed as in real identifiers, and not all alike."""
    distinct = lambda s: F.size(F.array_distinct(F.split(s, "")))
    if kind == "secret":
        return _vote((distinct(F.lower(hit)) >= 10) & hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"), distinct(F.lower(hit)) < 6)
    if kind in ("account", "identity", "local_phone"):
        return _vote(distinct(digits(hit)) >= 4, distinct(digits(hit)) < 3)
    return _vote(hit.rlike("[0-9_]"), F.length(hit) < 5)


def _proposals(text: Column) -> Column:
    """ARRAY<STRUCT<kind, start, end, votes, features>> of the proposed spans."""

    def part(kind: str, pattern: str) -> Column:
        gate = {"secret": text.rlike(r"[A-Fa-f0-9]{32}|[-_][A-Za-z0-9_-]{16}|AKIA"), "account": text.rlike(r"[A-Z]{2}[0-9]{2}"), "handle": F.contains(text, F.lit("@")),
                "identity": text.rlike(r"[0-9]-[0-9]{2}-[0-9]"), "local_phone": text.rlike(r"\([0-9]{2,5}\)")}[kind]

        def judged(s: Column) -> Column:
            left = F.lower(F.substring(text, F.greatest(s["start"] - LEFT + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(LEFT)).cast("int")))
            right = F.lower(F.substring(text, (s["end"] + 1).cast("int"), F.lit(RIGHT)))

            def of(c: Column) -> Column:
                cue = c["left"].rlike(rf"(?:{CUES[kind]})\W{{0,5}}(?:\w+\W{{1,3}}){{0,2}}$")
                against = c["left"].rlike(rf"(?:^|\W)(?:{AGAINST})\W{{0,5}}(?:\w+\W{{1,3}}){{0,1}}$")
                assigned = c["left"].rlike(r"[=:]\s*[\"']?$")
                quoted = c["right"].rlike(r"^[\"'\s.,;|]|^$")
                votes = F.concat(_strict(kind, s["hit"]).cast("string"), _vote(cue, against).cast("string"), _vote(assigned & quoted, ~quoted).cast("string"))
                word = F.regexp_extract(c["left"], r"(\w+)\W*$", 1)
                features = F.array(F.concat(F.lit("form"), _strict(kind, s["hit"]).cast("string")), F.concat(F.lit("cue"), _vote(cue, against).cast("string")),
                                   F.concat(F.lit("line"), _vote(assigned, ~quoted).cast("string")), F.concat(F.lit("length"), F.least(F.length(s["hit"]) / 8, F.lit(9)).cast("int").cast("string")),
                                   F.concat(F.lit("word"), F.pmod(F.xxhash64(word), F.lit(64)).cast("string")),
                                   F.concat(F.lit("mixed"), (s["hit"].rlike("[A-Z]") & s["hit"].rlike("[a-z]")).cast("string")))
                return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), votes.alias("votes"), features.alias("features"))

            return let(F.struct(left.alias("left"), right.alias("right")), of)

        none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,votes:string,features:array<string>>>")
        return F.when(gate, F.transform(matches(text, pattern), judged)).otherwise(none)

    return F.concat(*[part(kind, pattern) for kind, pattern in PROPOSALS.items()])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, one array of base spans per kind, and `proposed`, in one scan of the texts."""
    text = F.col("t")
    return (only(docs, "doc_id", "text").select("doc_id", text_of().alias("t"))
            .select("doc_id", *[F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(kind)
                                for kind, spans in base_spans(text).items()], _proposals(text).alias("proposed")))


def fit_labelers(patterns: list[tuple[str, int]]) -> tuple[dict[str, float], list[list[list[float]]]]:
    """EM for a two-class model with independent labelers, from (votes, count): the posterior of each vote pattern and, by
    labeler and class, the probability of each vote. Starts from the majority; counts are smoothed, so nothing is ever certain."""
    lean = lambda v: sum(int(x) - 1 for x in v)
    post = {v: 1 / (1 + math.exp(-1.5 * lean(v))) for v, _ in patterns}
    rates: list[list[list[float]]] = []
    for _ in range(ROUNDS):
        # a labeler is taken to be better than chance: ten pseudo-votes in its favour
        counts = [[[6.0, 3.0, 1.0], [1.0, 3.0, 6.0]] for _ in range(LABELERS)]
        prior = [1.0, 1.0]
        for v, n in patterns:
            for c, p in ((0, 1 - post[v]), (1, post[v])):
                prior[c] += n * p
                for k, x in enumerate(v):
                    counts[k][c][int(x)] += n * p
        rates = [[[x / sum(row) for x in row] for row in by_class] for by_class in counts]
        new = {}
        for v, _ in patterns:
            log = [math.log(prior[c]) + sum(math.log(rates[k][c][int(x)]) for k, x in enumerate(v)) for c in (0, 1)]
            new[v] = 1 / (1 + math.exp(max(-700, min(700, log[0] - log[1]))))
        moved = max((abs(new[v] - post[v]) for v in new), default=0)
        post = new
        if moved < 1e-6:
            break
    return post, rates


def train(found: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(log odds of each kind, weight of each kind:feature) of the span classifier.

    Proposals are counted by (kind, votes) and by (kind, feature, votes): at most 5 x 27 and 5 x 27 x about 90 rows.
    """
    spans = cut_lineage(found.select(F.explode("proposed").alias("p")).select("p.kind", "p.votes", "p.features"))
    votes = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    posterior = {kind: fit_labelers(sorted((r.votes, r.n) for r in votes if r.kind == kind))[0] for kind in {r.kind for r in votes}}
    prior: dict[str, list[float]] = {}
    for r in votes:
        p = posterior[r.kind][r.votes]
        total = prior.setdefault(r.kind, [1.0, 1.0])
        total[0] += r.n * (1 - p)
        total[1] += r.n * p
    sums: dict[str, list[float]] = {}
    for r in spans.select("kind", "votes", F.explode("features").alias("feature")).groupBy("kind", "votes", "feature").agg(F.count("*").alias("n")).collect():
        p = posterior[r.kind][r.votes]
        at = sums.setdefault(f"{r.kind}:{r.feature}", [0.5, 0.5])
        at[0] += r.n * (1 - p)
        at[1] += r.n * p
    odds = {k: math.log(v[1] / v[0]) for k, v in prior.items()}
    weights = {f: math.log(v[1] / prior[f.partition(":")[0]][1]) - math.log(v[0] / prior[f.partition(":")[0]][0]) for f, v in sums.items()}
    return odds, weights


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(float(v)))]) if values else F.create_map().cast("map<string,double>")


def classify(found: DataFrame, model: tuple[dict[str, float], dict[str, float]]) -> DataFrame:
    """`found` with `added`: the proposed spans that the classifier accepts."""
    odds, weights = _map(model[0]), _map(model[1])
    value = lambda p: F.aggregate(p["features"], F.coalesce(F.try_element_at(odds, p["kind"]), F.lit(-1.0)), lambda a, f: a + F.coalesce(
        F.try_element_at(weights, F.concat(p["kind"], F.lit(":"), f)), F.lit(0.0)))
    return found.withColumn("added", F.transform(F.filter("proposed", lambda p: value(p) >= 0), lambda p: F.struct(
        p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"))))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans by kind, and the added spans."""
    found = cut_lineage(candidates(docs))
    return classify(found, train(found))


def report(found: DataFrame) -> DataFrame:
    """One digest row per document. An added span that lies inside a base span is left out."""
    text = lambda kind, s: F.concat_ws(":", kind, s["start"], s["end"])
    named = lambda k: F.transform(F.col(k), lambda s: text(F.lit(k), s))
    base = F.concat(*[named(k) for k in KINDS])
    taken = F.concat(*KINDS)
    fresh = F.filter("added", lambda a: ~F.exists(taken, lambda b: (b["start"] <= a["start"]) & (b["end"] >= a["end"])))
    extra = F.transform(F.array_sort(fresh), lambda a: text(a["kind"], a))
    return found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                        F.array_join(F.concat(base, extra), ",").alias("spans"))
