"""Personal data by weak supervision: labelers vote, expectation-maximisation
weighs them, a classifier trained on its posteriors decides on spans.

Base spans come from four fixed patterns and always stay. Further candidates
come from loose patterns of all four kinds: addresses with the at sign written
out; addresses of IPv6, of dots written out and of parts over 255; groups of 12
to 19 digits of any grouping or checksum; telephone numbers without a country
code and bare runs of digits. Labelers vote for, against or not at all on each
candidate, base or not: the pattern that found it, a structural check,
gazetteers of endings and prefixes, words before it, and what it is embedded
in. They disagree, and none is taken at its word: counts of (kind, votes)
patterns, of which there are 4 * 3^5 at most, are all that leaves Spark; on them
EM estimates how often each labeler casts each vote on true and on false
candidates, from a start at the majority of votes, and a logistic classifier of
kind and votes is fitted to the posteriors. It is applied as a column
expression.

Spark has no function for the places of all matches. The pieces between the
matches, from a split by the same pattern, and the matches themselves give them
as running sums of lengths. Sums and merges run in chunks, and parts of a text
are cut out of pieces of bounded size, so that a text with very many matches
takes no quadratic time. Patterns are written so that Java's matcher doesn't
recurse on long texts, with the same matches as the plain form.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common

KINDS = ("email", "ip", "card", "phone")
NAME = r"[A-Za-z0-9._%+-]"
BASE = {
    # a match starts where a run of such characters does, or right after a match
    "email": rf"(?:\G|(?<!{NAME})){NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    # whole runs of 14 to 19 digits; shorter and longer ones fail
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{NAME}){NAME}++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|[0-9](?<![0-9.\]][0-9])[0-9]*+(?:\[?\.\]?[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20.-][0-9])(?:[\x20.-]?[0-9]){11,18}+(?![\x20.-]?[0-9])",
    "phone": r"\(?[0-9](?<![0-9+.-][(]?[0-9])(?:[0-9]{1,4}\)?[-.\x20/]){1,3}[0-9]{4,8}(?![0-9.-])|[0-9](?<![0-9][0-9])[0-9]{6,14}+(?![0-9])",
}
GUARD = {"email": "@", "phone": "+"}
LOOSE_GUARD = {"email": "at", "ip": ".:", "card": "0123456789", "phone": "0123456789"}
ENDINGS = "com|org|net|edu|gov|int|info|io|co|uk|de|fr|es|it|eu|us|ca|ch|at|be|nl|mx|ar|example|test|invalid|local"
COUNTRIES = "1|20|27|30|31|32|33|34|36|39|4[0-9]|5[1-8]|6[0-6]|7|81|82|84|86|9[0-58]|2[1-9][0-9]|3[578][0-9]|42[0-9]|[58]5[0-9]|9[679][0-9]"
BEFORE = {
    "email": "mail|contact|write|kontakt|correo|courriel|reply|from|to:",
    "ip": r"\bip\b|ipv6|host|server|addr|login|client|serveur|servidor",
    "card": "card|visa|master|amex|pay|karte|carte|tarjeta|credit|kredit",
    "phone": "tel|phone|call|fax|mobil|cell|anruf|appel|llam",
}
NOT_BEFORE = r"(?:isbn|issn|doi|version|release|sha|id|no|nr|ref|order|invoice|token|key|secret|hash)[\s:=.#\x20\"']*$|[#§$][\x20]?$"
LABELERS = ("pattern", "structure", "gazetteer", "before", "embedded")
CONTEXT, CHUNK, ACCEPT = 24, 64, 0.9
#: Code points of a piece of a text that parts are cut out of.
PIECE = 512


def running(df: DataFrame, names: list[str], least: int, advance: Callable[[Column, Column], Column], merge: Callable[[Column, Column], Column], give: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """df with give(state, item) in place of each item of the named arrays, in
    order, `state` being that before the item and advance(state, item) that
    after it, `least` that before all; merge(state, state) joins those of two
    stretches. `out` is the type of the results. Spark copies a running state
    for each item, so results run in chunks, and what comes before a chunk is
    known from the states of all. Steps are columns of their own, which keeps
    plans of nested functions small."""
    start, none = F.lit(least), F.array().cast(f"array<{out}>")
    last = lambda n: F.size(n) - 1
    chunk = lambda n: lambda c: F.transform(F.sequence(c * CHUNK, F.least(c * CHUNK + (CHUNK - 1), last(n))), lambda i: F.get(n, i))
    df = df.withColumns({f"{n}_c": F.when(F.size(n) > 0, F.transform(F.sequence(F.lit(0), F.floor(last(n) / CHUNK).cast("int")), chunk(n))) for n in names})
    df = df.withColumns({f"{n}_t": F.transform(f"{n}_c", lambda c: F.aggregate(c, start, advance)) for n in names})
    df = df.withColumns({f"{n}_t": F.aggregate(f"{n}_t", F.array(start), lambda s, x: F.concat(s, F.array(merge(F.element_at(s, -1), x)))) for n in names})
    step = lambda s, x: F.struct(advance(s["state"], x).alias("state"), F.concat(s["out"], F.array(give(s["state"], x))).alias("out"))
    within = lambda n: lambda c, i: F.aggregate(c, F.struct(F.get(f"{n}_t", i).alias("state"), none.alias("out")), step, lambda s: s["out"])
    # a column that is used once would be merged into the function and be made anew for each chunk
    df = df.withColumns({n: F.when(F.size(f"{n}_t") > 0, F.flatten(F.transform(f"{n}_c", within(n)))).otherwise(none) for n in names})
    return df.drop(*[f"{n}_{x}" for n in names for x in "ct"])


def places(df: DataFrame, text: str, patterns: dict[str, tuple[str, str | None]]) -> DataFrame:
    """df with a column for each named (pattern, guard): start, end (exclusive, in
    code points) of all matches, left to right. A text without any of the guard's
    characters, or without the whole guard if it is letters, has none."""

    def held(guard: str | None) -> Column:
        if guard is None:
            return F.lit(True)
        return F.instr(text, guard) > 0 if guard.isalpha() or len(guard) == 1 else F.translate(text, guard, "") != F.col(text)

    df = df.withColumns({n: F.when(held(g), F.regexp_extract_all(text, F.lit(p), F.lit(0))) for n, (p, g) in patterns.items()})
    lengths = lambda n, p: F.zip_with(F.split(text, p, -1), F.col(n), lambda g, m: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("own")))
    df = df.withColumns({n: F.when(F.size(n) > 0, lengths(n, p)) for n, (p, _) in patterns.items()})
    span = lambda at, e: F.struct((at + e["gap"]).alias("start"), (at + e["gap"] + e["own"]).alias("end"))
    df = running(df, list(patterns), 0, lambda at, e: at + e["gap"] + e["own"], lambda x, y: x + y, span, "struct<start:int,end:int>")
    return df.withColumns({n: F.filter(n, lambda s: s["end"] > s["start"]) for n in patterns})


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The text between two places, from its pieces."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    at, piece = start - first * PIECE, lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    inside = F.substring(piece(first), at + 1, end - start)
    middle = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    over = F.concat(F.substring(piece(first), at + 1, F.lit(PIECE)), middle, F.substring(piece(last), F.lit(1), end - last * PIECE))
    return F.when(end <= start, F.lit("")).when(first == last, inside).otherwise(over)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substring(number, -i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def quad(match: Column) -> Column:
    return F.forall(F.split(match, r"\[?\.\]?"), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))


def valid(kind: str, match: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    if kind == "ip":
        return quad(match)
    if kind == "card":
        return luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


def votes(kind: str, match: Column, left: Column, right: Column, strict: Column) -> Column:
    """An array of 1, -1 or 0 (no vote) in order of LABELERS."""
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0).cast("tinyint")
    never = F.lit(False)
    n = F.length(digits(match))
    dated = match.rlike("^(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,4}")
    grouped = match.rlike(r"[0-9][\x20().\-/]+[0-9]")
    six = F.length(match) - F.length(F.replace(match, F.lit(":"), F.lit("")))  # colons
    structure, gazetteer = {
        "email": (vote(match.rlike("[.][A-Za-z]{2,}$|dot[\\])]\\x20?[A-Za-z]{2,}$"), match.rlike("^[.-]|[0-9]$")), vote(F.lower(match).rlike(f"[.\\])]\\x20?(?:{ENDINGS})$"), never)),
        "ip": (
            vote(((six == 7) & match.rlike("[0-9]") & match.rlike(":[0-9A-Fa-f]{3,4}")) | ((six == 0) & quad(match) & ~match.rlike("(?:^|[.])0[0-9]") & ~match.rlike("^0")), ((six == 0) & ~quad(match)) | ((six > 0) & (six != 7)) | match.rlike("^0[.]|(?:[.]0){3}$")),
            vote(match.rlike("^(?:10|127|192[.]168|172)[.]|^(?i:fe80|fd|200[1-3]):"), match.rlike("^[0-9](?:[.][0-9]){3}$|^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$")),
        ),
        "card": (vote(luhn(digits(match)), ~luhn(digits(match))), vote(digits(match).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)") & n.between(13, 19), digits(match).rlike("^[01789]") | (n < 13))),
        "phone": (
            vote(grouped & n.between(9, 15) & ~dated, ~grouped | (n < 7) | dated),
            vote(match.rlike(f"^[+](?:{COUNTRIES})") | match.rlike("^[(]?0?[2-9][0-9]{2}\\)?[-. /]"), match.rlike("^[(]?1") | match.rlike("^[0-9]+$")),
        ),
    }[kind]
    embedded = left.rlike("[a-z0-9_/=]$") | right.rlike("^[A-Za-z0-9_/=]")
    return F.array(vote(strict, ~strict), structure, gazetteer, vote(left.rlike(BEFORE[kind]), left.rlike(NOT_BEFORE)), vote(never, embedded))


def apart(df: DataFrame, base: str, more: str) -> DataFrame:
    """df with a column `more` that has left only spans that overlap none of
    `base`: of all in order of their starts, those that begin after the ends of
    earlier base ones, and the same from the other side."""
    bare = lambda a, more: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(more).alias("more"), s["end"].alias("end"), s["kind"].alias("kind")))
    turned = lambda a: F.transform(a, lambda s: F.struct((-s["end"]).alias("start"), s["more"].alias("more"), (-s["start"]).alias("end"), s["kind"].alias("kind")))
    reach = lambda at, s: F.when(s["more"], at).otherwise(F.greatest(at, s["end"]))
    held = lambda at, s: F.when(~s["more"] | (s["start"] >= at), s)
    df = df.withColumn("_m", F.when((F.size(base) > 0) & (F.size(more) > 0), F.sort_array(F.concat(bare(base, False), bare(more, True)))))
    for _ in range(2):
        df = running(df, ["_m"], -(2**30), reach, F.greatest, held, "struct<start:int,more:boolean,end:int,kind:int>")
        df = df.withColumn("_m", F.sort_array(turned(F.array_compact("_m"))))
    return df.withColumn(more, F.when(F.size(base) > 0, F.filter("_m", lambda s: s["more"])).otherwise(bare(more, True))).drop("_m")


def candidates(docs: DataFrame) -> DataFrame:
    """The rows with `base` and `more`: arrays of (start, kind, end, votes), kind
    as its number in KINDS, in that order."""
    found = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_pieces", pieces(F.col("_text")))
    found = places(found, "_text", {f"_b{k}": (p, GUARD.get(k)) for k, p in BASE.items()} | {f"_l{k}": (p, LOOSE_GUARD[k]) for k, p in LOOSE.items()})
    part = lambda start, end: cut(F.col("_pieces"), start, end)
    check = lambda k: lambda s: valid(k, part(s["start"], s["end"]))
    checked = {f"_b{k}": F.filter(f"_b{k}", check(k)) for k in KINDS if k != "email"}
    of = lambda n, k: F.transform(n, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), s["end"].alias("end")))
    found = found.withColumns(checked)
    # a stretch that loose patterns of two kinds find is a candidate of both
    found = found.withColumns({"_base": F.sort_array(F.concat(*[of(f"_b{k}", k) for k in KINDS])), "_more": F.concat(*[of(f"_l{k}", k) for k in KINDS])})
    found = apart(found.drop(*[f"_{x}{k}" for k in KINDS for x in "bl"]), "_base", "_more")
    own = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), F.lit(False).alias("more"), s["end"].alias("end"), s["kind"].alias("kind")))

    def seen(s: Column) -> Column:
        left = F.lower(part(F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"]))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["more"].alias("more"), part(s["start"], s["end"]).alias("match"), left.alias("left"), part(s["end"], s["end"] + 1).alias("right"))

    found = found.withColumn("_all", F.transform(F.concat(own, F.col("_more")), seen)).drop("_text", "_pieces", "_base", "_more")

    def judged(s: Column) -> Column:
        by_kind = F.when(s["kind"] == 0, votes(KINDS[0], s["match"], s["left"], s["right"], ~s["more"]))
        for k, kind in enumerate(KINDS[1:], 1):
            by_kind = by_kind.when(s["kind"] == k, votes(kind, s["match"], s["left"], s["right"], ~s["more"]))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), by_kind.alias("votes"), s["more"].alias("more"))

    found = found.withColumn("_all", F.transform("_all", judged))
    half = lambda more: F.expr(f"transform(filter(_all, s -> {more}s.more), s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end, 'votes', s.votes))")
    return found.withColumns({"base": half("not "), "more": half("")}).drop("_all")


def vote_counts(found: DataFrame) -> list[tuple[int, tuple[int, ...], int]]:
    """(kind, votes, how many), at most 4 * 3^5 of them."""
    rows = found.select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in rows)


def chance(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def estimate(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 100) -> tuple[list[tuple[float, float]], list[float]]:
    """EM over latent truth: how often a vote of each labeler is right on true
    and on false candidates, of those that it casts, and the posterior of each
    pattern. Shares of true candidates by kind are estimated too. Each rate has
    five counts before any are seen, four of them right: labelers are thought to
    be better than chance until many votes say otherwise."""
    post = [chance(float(sum(v))) for _, v, _ in counts]
    rates: list[tuple[float, float]] = []
    for _ in range(rounds):
        rates = []
        for j in range(len(LABELERS)):
            cast = [(n, p, v[j]) for (_, v, n), p in zip(counts, post, strict=True) if v[j]]
            yes = (sum(n * p for n, p, x in cast if x > 0) + 4) / (sum(n * p for n, p, _ in cast) + 5)
            no = (sum(n * (1 - p) for n, p, x in cast if x < 0) + 4) / (sum(n * (1 - p) for n, p, _ in cast) + 5)
            rates.append((yes, no))
        prior = []
        for k in range(len(KINDS)):
            own = [(n, p) for (kind, _, n), p in zip(counts, post, strict=True) if kind == k]
            prior.append((sum(n * p for n, p in own) + 1) / (sum(n for n, _ in own) + 2))
        weigh = lambda x, yes, no: math.log(yes / (1 - no)) if x > 0 else math.log((1 - yes) / no) if x < 0 else 0.0
        post = [chance(math.log(prior[kind] / (1 - prior[kind])) + sum(weigh(x, *r) for r, x in zip(rates, v, strict=True))) for kind, v, _ in counts]
    return rates, post


def features(kind: int, vote: tuple[int, ...]) -> list[float]:
    return [float(kind == k) for k in range(len(KINDS))] + [float(v > 0) for v in vote] + [float(v < 0) for v in vote]


def train(counts: list[tuple[int, tuple[int, ...], int]], post: list[float], steps: int = 600, rate: float = 1.0) -> list[float]:
    """Weights of a logistic classifier of kind and votes, fitted to the
    posteriors. Patterns count by the root of their number, so that the common
    ones don't decide alone."""
    weights = [0.0] * (len(KINDS) + 2 * len(LABELERS))
    total = sum(math.sqrt(n) for *_, n in counts) or 1
    rows = [(features(k, v), math.sqrt(n) / total, p) for (k, v, n), p in zip(counts, post, strict=True)]
    for _ in range(steps):
        slope = [1e-4 * w for w in weights]
        for x, share, p in rows:
            error = share * (chance(sum(a * b for a, b in zip(weights, x, strict=True))) - p)
            slope = [s + error * b for s, b in zip(slope, x, strict=True)]
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def accepted(weights: list[float]) -> Callable[[Column], Column]:
    by_kind, yes, no = weights[: len(KINDS)], weights[len(KINDS) : -len(LABELERS)], weights[-len(LABELERS) :]
    need = math.log(ACCEPT / (1 - ACCEPT))

    def decide(span: Column) -> Column:
        score = F.get(F.array(*map(F.lit, by_kind)), span["kind"])
        for j in range(len(LABELERS)):
            vote = F.get(span["votes"], F.lit(j))
            score = score + F.when(vote > 0, yes[j]).when(vote < 0, no[j]).otherwise(0.0)
        return score >= need

    return decide


def find_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, base and spans for every row: sorted arrays of (start, kind,
    end), spans holding the base ones and those the classifier adds.

    A null text counts as empty and has none. Repeated rows are found alike,
    ids play no part, and an empty table gives no rows. Very long texts with
    very many matches take time and memory of their length.
    """
    found = common.written(candidates(docs).select(*keep, "base", "more"), "candidates")
    counts = vote_counts(found)
    _, post = estimate(counts)
    taken = F.filter("more", accepted(train(counts, post)))
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select(*keep, bare("base").alias("base"), F.sort_array(bare(F.concat("base", taken))).alias("spans"))


def told(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(df: DataFrame, text: str, spans: str) -> DataFrame:
    """df with [EMAIL], [IP], [CARD] or [PHONE] in the text in place of each of
    its spans; spans that overlap are one, of the first one's kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # of each span, the end of what came before
    step = lambda at, s: F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    df = df.withColumn("_s", F.col(spans)).withColumn("_pieces", F.when(F.size("_s") > 0, pieces(F.col(text))))
    df = running(df, ["_s"], 0, lambda at, s: F.greatest(at, s["end"]), F.greatest, step, "struct<at:int,start:int,end:int,kind:int>")
    part = lambda s: F.when(s["start"] >= s["at"], F.concat(cut(F.col("_pieces"), s["at"], s["start"]), F.get(names, s["kind"]))).otherwise("")
    last = F.array_max(F.transform("_s", lambda s: s["end"]))
    done = F.concat(F.array_join(F.transform("_s", part), ""), F.substring(text, last + 1, F.length(text)))
    return df.withColumn(text, F.when(F.size("_s") > 0, done).otherwise(F.col(text))).drop("_s", "_pieces")
