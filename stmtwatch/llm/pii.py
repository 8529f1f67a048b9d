"""Personal data: fixed patterns, and spans found by weak supervision.

Base spans are matches of four patterns that pass a check. Further spans are candidates: long mixed
strings and account numbers (`secret`), long runs of digits (`number`), streets with a house number
(`address`), titles or first names with capitalised words (`name`). Six labelers vote on each: its
shape, a gazetteer of words in or before it, its immediate context, its mix of characters, its check
digits, and where it stands. They disagree, and keep silent where they know nothing.
Expectation-maximisation over the counts of vote combinations estimates how reliable each labeler is
and how common private spans are in each kind; its posteriors train a logistic classifier on votes,
kind and length, which decides on each candidate.

All work on texts is SQL expressions. What reaches the driver are counts by combination of votes,
kind and length: 20,412 rows at most, whatever the input; they cover all documents. Starts and ends
are code points. Positions are running sums over the lengths of matches and of the gaps between
them, taken in blocks, so very long texts and texts with very many matches stay cheap.

Nulls count as empty texts without spans. Repeated rows give repeated results. Candidates that
touch a base span are left out; of overlapping candidates that are accepted, a secret or number goes
before an address, and that before a name. Without candidates, as in an empty table, nothing is
trained and nothing is added. Columns `base` and `spans` of the input are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwatch.llm.common import bind, whole_text
from stmtwatch.operators.lookup import computed_once

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "number", "address", "name")
# The patterns, with possessive loops. A run can only match from its start (or from where the last
# match ended), so looking back spares a long run from being tried at each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What every match of a pattern holds.
HINTS = {"email": "@", "phone": "+"}
# Words that announce private values, and words that announce plain numbers.
PRIVATE_WORDS = (
    "token|key|apikey|secret|password|passwd|passwort|contraseña|auth|bearer|credential|account|konto|"
    "compte|cuenta|iban|ssn|passport|card|karte|carte|tarjeta"
)
PLAIN_WORDS = "page|vol|isbn|issn|version|chapter|figure|table|seite|seiten|página|pages"
# Titles, frequent first names, words before a person or a place, and street words.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Sr|Sra|Monsieur|Madame|Mme"
FIRST_NAMES = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|David|Elizabeth|William|Susan|Thomas|Sarah|Anna|Peter|Paul|"
    "Hans|Klaus|Jürgen|Ursula|Monika|Sabine|Pierre|Jean|Marie|Nathalie|Isabelle|José|Juan|Carlos|Carmen|Luis"
)
PERSON_WORDS = "by|from|with|dear|contact|name|named|von|bei|liebe|lieber|par|avec|chez|por|con|nombre|nom"
PLACE_WORDS = "at|in|lives|wohnt|habite|vive|address|adresse|dirección"
STREETS = "Street|Avenue|Road|Lane|Boulevard|Drive|Court|Square"
STREETS_BEFORE = "rue|avenue|boulevard|calle|avenida|plaza|paseo"
STREETS_WITHIN = "straße|strasse|gasse|weg|platz|allee"
_CAPITAL = r"\p{Lu}[\p{L}'-]++"
_STREET_NAME = rf"(?:{STREETS_BEFORE})\x20(?:de\x20|la\x20|du\x20|del\x20){{0,2}}{_CAPITAL}"
CANDIDATES = {
    "secret": r"(?:\G|(?<![A-Za-z0-9]))[A-Z]{2}[0-9]{2}(?:\x20[0-9A-Z]{4}){2,7}+(?:\x20[0-9A-Z]{1,4})?+(?![A-Za-z0-9])"
              r"|(?:\G|(?<![A-Za-z0-9_+/-]))[A-Za-z0-9_+/-]{16,}+|(?:\G|(?<![0-9]))[0-9](?:[\x20.-]?[0-9]){8,}+",
    "address": rf"(?:\G|(?<![0-9]))[0-9]{{1,5}}(?:\x20{_CAPITAL}){{1,3}}(?<=\x20(?:{STREETS}))"
               rf"|(?:\G|(?<!\p{{L}}))\p{{Lu}}\p{{L}}{{2,30}}(?<={STREETS_WITHIN})\x20[0-9]{{1,4}}+"
               rf"|(?:\G|(?<![0-9]))[0-9]{{1,4}},?+\x20{_STREET_NAME}"
               rf"|(?:\G|(?<!\p{{L}})){_STREET_NAME},?+\x20[0-9]{{1,4}}+",
    "name": rf"(?:\G|(?<!\p{{L}}))(?:(?:{TITLES})\.?+(?:\x20{_CAPITAL}){{1,3}}+|(?:{FIRST_NAMES})(?:\x20{_CAPITAL}){{1,2}}+)",
}
# A text without a match of this has no candidate of the kind.
CANDIDATE_HINTS = {
    "address": rf"\x20(?:{STREETS})|(?:{STREETS_WITHIN})\x20[0-9]|(?<!\p{{L}})(?:{STREETS_BEFORE})\x20",
    "name": rf"(?<!\p{{L}})(?:{TITLES}|{FIRST_NAMES})[.\x20]",
}
CONTEXT = 24
LABELERS = ("shape", "gazetteer", "context", "mix", "checksum", "place")


# --- positions ------------------------------------------------------------------------------------


def _running_sums(lens: str) -> str:
    """SQL: the sum before each element of an array of ints, in blocks of about its root."""
    size = f"size({lens})"
    block = f"slice({lens}, c * b + 1, b)"
    total = lambda part: f"aggregate({part}, 0L, (s, y) -> s + y)"
    whole = "sequence(0, ({0} - 1) div b)".format(size)
    body = bind(
        f"transform({whole}, c -> {total(block)})", "sums",
        f"flatten(transform({whole}, c -> " + bind(
            total("slice(sums, 1, c)"), "base",
            bind(block, "part", f"transform(part, (x, j) -> base + {total('slice(part, 1, j)')})"),
        ) + "))",
    )
    return f"if({size} = 0, cast(array() as array<bigint>), " + bind(f"cast(ceil(sqrt({size})) as int)", "b", body) + ")"


def _quoted(pattern: str) -> str:
    """SQL: a regular expression as a literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(text: str, pattern: str) -> str:
    """SQL: leftmost non-overlapping matches as structs of start, value, before and after."""
    regex = _quoted(pattern)
    lens = "transform(m, (x, i) -> cast(length(g[i]) + length(x) as bigint))"
    rows = bind(
        _running_sums("d"), "at",
        "transform(m, (x, i) -> named_struct('start', at[i] + length(g[i]), 'value', x, "
        f"'before', right(g[i], {CONTEXT}), 'after', left(g[i + 1], 1)))",
    )
    return bind(f"regexp_extract_all({text}, {regex}, 0)", "m", bind(
        f"if(size(m) = 0, array(''), split({text}, {regex}, -1))", "g", bind(lens, "d", rows)
    ))


def _luhn(digits: str) -> str:
    """SQL: do the digits pass Luhn's check?"""
    at = f"(ascii(substr({digits}, length({digits}) + 1 - i, 1)) - 48) * if(i % 2 = 0, 2, 1)"
    return (
        f"aggregate(sequence(1, length({digits})), 0, (t, i) -> t + " + bind(at, "d", "if(d > 9, d - 9, d)") + ") % 10 = 0"
    )


def _mod_97(value: str) -> str:
    """SQL: do the check digits of an account number fit? Letters count as 10 to 35."""
    digit = "ascii(substr(w, i, 1)) < 58"
    return bind(value, "v", bind("concat(substr(v, 5), left(v, 4))", "w", (
        f"aggregate(sequence(1, length(w)), 0, (t, i) -> (t * if({digit}, 10, 100) + ascii(substr(w, i, 1)) - "
        f"if({digit}, 48, 55)) % 97) = 1"
    )))


CHECKS = {
    "email": "true",
    "ip": "forall(split(s.value, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 and "
          "cast(concat('0', right(trim(LEADING '0' FROM p), 3)) as int) <= 255)",
    "card": bind("translate(s.value, ' -', '')", "n", f"if(length(n) not between 16 and 19, false, {_luhn('n')})"),
    "phone": "length(regexp_replace(s.value, '[^0-9]', '')) between 8 and 15",
}


def _spans(kind: str, matches: str) -> str:
    return (
        f"transform(filter({matches}, s -> {CHECKS[kind]}), s -> "
        f"named_struct('kind', '{kind}', 'start', s.start, 'end', s.start + length(s.value)))"
    )


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `base`: an array of kind, start and end, by kind and start."""
    parts = []
    for kind in BASE_KINDS:
        spans = _spans(kind, found("_text", PATTERNS[kind]))
        none = "cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)"
        parts.append(f"if(contains(_text, '{HINTS[kind]}'), {spans}, {none})" if kind in HINTS else spans)
    named = docs.withColumn("_text", whole_text(text))
    return computed_once(named, base=F.expr(f"concat({', '.join(parts)})")).drop("_text")


# --- labelers -------------------------------------------------------------------------------------


def _votes() -> dict[str, str]:
    """SQL per labeler over a candidate `s`: 1 for private, -1 against, 0 for no opinion."""
    digits = "length(regexp_replace(s.value, '[^0-9]', ''))"
    letters = "length(regexp_replace(s.value, '[^A-Za-z]', ''))"
    like = lambda of, pattern: f"{of} rlike {_quoted(pattern)}"
    value, before, after = "s.value", "s.before", "s.after"
    named, placed, worded = "s.kind = 'name'", "s.kind = 'address'", "s.kind in ('address', 'name')"
    account = like(value, r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,38}$")
    private_shape = (
        r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,38}|AKIA[A-Z0-9]{16}"
        r"|(?:sk|pk|gh[pousr]|xox[bap])[_-].{16,}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"
    )
    plain_shape = r"^[A-Za-z_/-]*$|^[0-9 .-]*[ .][0-9 .-]*$"
    first_name = rf"^(?:(?:{TITLES})[.]? )?(?:{FIRST_NAMES}) "
    word = lambda words, end="": rf"(?<!\p{{L}})(?:{words})(?!\p{{L}}){end}"
    checked = bind("regexp_replace(s.value, '[^0-9]', '')", "n", _luhn("n"))
    account_checked = _mod_97("translate(s.value, ' ', '')")
    return {
        "shape": f"case when {named} then if({like(value, rf'{_CAPITAL} {_CAPITAL}$')}, 1, -1) "
                 f"when {placed} then if({like(value, r'^[0-9]{4}|[0-9]{4}$')}, -1, 1) "
                 f"when {like(value, private_shape)} then 1 when {like(value, plain_shape)} then -1 else 0 end",
        "gazetteer": f"case when {named} then if({like(value, first_name)}, 1, 0) when {placed} then 0 "
                     f"when {like('lower(s.before)', word(PRIVATE_WORDS))} then 1 "
                     f"when {like('lower(s.before)', word(PLAIN_WORDS))} then -1 else 0 end",
        "context": f"case when {like(before, r'\p{L}$')} or {like(after, r'\p{L}')} then -1 "
                   f"when {like(before, r'[:=][ \t]*["\']?$')} then 1 "
                   f"when {named} and {like('lower(s.before)', word(PERSON_WORDS, ' $'))} then 1 "
                   f"when {placed} and {like('lower(s.before)', word(PLACE_WORDS, ',? $'))} then 1 else 0 end",
        "mix": f"case when {worded} then 0 when {letters} > 0 and {digits} * 5 between s.size and s.size * 4 then 1 "
               f"when s.kind = 'secret' and {digits} = 0 then -1 "
               f"when s.kind = 'number' and {like(value, r'^([0-9])\1*$|^0*12345|00000$')} then -1 else 0 end",
        "checksum": f"case when {worded} then 0 when {account} then if({account_checked}, 1, -1) "
                    f"when s.kind = 'number' and {digits} between 12 and 19 then if({checked}, 1, -1) else 0 end",
        "place": f"case when {like(before, r'[/\\._@#&%?-]$')} or {like(after, r'[/\\_@&%=]')} then -1 "
                 f"when {like(before, r'["\'`(<]$')} and {like(after, r'["\'`)>]')} then 1 "
                 f"when {named} and {like(before, r'(?:^|[.!?] )$')} then -1 else 0 end",
    }


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `candidates`: kind, start, end, votes and length class of each candidate."""
    votes = ", ".join(f"'{n}', cast({v} as int)" for n, v in _votes().items())
    parts = []
    for kind, pattern in CANDIDATES.items():
        named = "if(s.value rlike '[A-Za-z]', 'secret', 'number')" if kind == "secret" else f"'{kind}'"
        # Where the hint is missing, the text searched is empty.
        hint = CANDIDATE_HINTS.get(kind)
        searched = "_text" if hint is None else f"if(_text rlike {_quoted(hint)}, _text, '')"
        matches = bind(searched, "searched", found("searched", pattern))
        parts.append(
            f"transform({matches}, s -> named_struct('kind', {named}, 'start', s.start, 'value', s.value, "
            "'before', s.before, 'after', s.after, 'size', length(s.value)))"
        )
    made = (
        f"transform(concat({', '.join(parts)}), s -> named_struct('kind', s.kind, 'start', s.start, "
        f"'end', s.start + s.size, 'long', cast(least(s.size div 8, 6) as int), {votes}))"
    )
    named = docs.withColumn("_text", whole_text(text))
    return computed_once(named, candidates=F.expr(made)).drop("_text")


# --- learning from counts -------------------------------------------------------------------------


Votes = tuple[int, ...]


@dataclass(frozen=True)
class SpanModel:
    """Reliability of the labelers, and the final classifier."""

    prior: dict[str, float]  # kind -> share of private ones
    reliability: dict[str, dict[tuple[int, int], float]]  # labeler -> (class, vote) -> probability
    weights: dict[tuple[str, int | str], float]  # (feature, value) -> weight
    offset: float


def posterior(prior: float, rates: dict, votes: Votes) -> float:
    """Probability that a candidate is private. A labeler without an opinion says nothing."""
    odds = prior / (1 - prior)
    for name, vote in zip(LABELERS, votes):
        if vote:
            odds *= rates[name][1, vote] / rates[name][0, vote]
    return odds / (1 + odds)


def estimate(counts: list[tuple[Votes, str, int, int]], rounds: int = 30) -> tuple[dict, dict, dict]:
    """Expectation-maximisation from (votes, kind, length class, n): share of private ones by kind,
    reliabilities where a labeler speaks, and the posterior of each (votes, kind)."""
    soft = {(v, kind): 1 / (1 + math.exp(-1.5 * sum(v))) for v, kind, _, _ in counts}
    prior, rates = {}, {}
    for _ in range(rounds):
        for kind in sorted({k for _, k in soft}):
            met = [(n, soft[v, k]) for v, k, _, n in counts if k == kind]
            share = (sum(n * p for n, p in met) + 1) / (sum(n for n, _ in met) + 2)
            prior[kind] = min(0.95, max(0.05, share))
        for i, name in enumerate(LABELERS):
            rates[name] = {}
            for c in (0, 1):
                # A labeler is at least a little better than chance.
                seen = {vote: 2.0 if vote == (1 if c else -1) else 1.0 for vote in (-1, 1)}
                for v, kind, _, n in counts:
                    if v[i]:
                        seen[v[i]] += n * (soft[v, kind] if c else 1 - soft[v, kind])
                for vote in (-1, 1):
                    rates[name][c, vote] = seen[vote] / sum(seen.values())
        soft = {(v, kind): posterior(prior[kind], rates, v) for v, kind in soft}
    return prior, rates, soft


def _features(votes: Votes, kind: str, long: int) -> list[tuple[str, int | str]]:
    return [*zip(LABELERS, votes), ("kind", kind), ("long", long)]


def learn(counts: list[tuple[Votes, str, int, int]], rounds: int = 30, steps: int = 400) -> SpanModel | None:
    """From (votes, kind, length class, n): estimate reliabilities, then fit the classifier."""
    if not counts:
        return None
    prior, rates, soft = estimate(counts, rounds)
    names = sorted({f for v, kind, long, _ in counts for f in _features(v, kind, long)}, key=str)
    place = {f: i for i, f in enumerate(names)}
    rows = np.array([[place[f] for f in _features(v, kind, long)] for v, kind, long, _ in counts])
    aims = np.array([soft[v, kind] for v, kind, _, _ in counts])
    # A combination counts by the root of its number, so that rare kinds are learnt too.
    share = np.sqrt([n for *_, n in counts])
    share /= share.sum()
    weights, offset = np.zeros(len(names)), 0.0
    for _ in range(steps):
        z = np.clip(offset + weights[rows].sum(axis=1), -30, 30)
        error = share * (1 / (1 + np.exp(-z)) - aims)
        slope = np.bincount(rows.ravel(), np.repeat(error, rows.shape[1]), len(names))
        offset -= 2 * error.sum()
        weights -= 2 * (slope + 1e-4 * weights)
    return SpanModel(prior, rates, {f: float(w) for f, w in zip(names, weights)}, float(offset))


def fit(docs: DataFrame, text: str = "text") -> SpanModel | None:
    """Learn from the candidates of all documents, by counts per combination."""
    each = with_candidates(docs.select(text), text).select(F.inline("candidates"))
    counts = each.groupBy(*LABELERS, "kind", "long").agg(F.count(F.lit(1)).alias("n")).collect()
    return learn(sorted((tuple(r[name] for name in LABELERS), r.kind, r.long, r.n) for r in counts))


def _accepted(model: SpanModel) -> str:
    """SQL over a candidate `s`: does the classifier call it private? Some labeler must have done so."""
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    terms = [f"{model.offset!r}D"] + [
        f"if(s.{name} = {value(v)}, {weight!r}D, 0D)" for (name, v), weight in model.weights.items()
    ]
    spoken = " or ".join(f"s.{name} = 1" for name in LABELERS)
    return f"({spoken}) and ({' + '.join(terms)}) > 0"


def with_spans(docs: DataFrame, text: str = "text", model: SpanModel | None = None) -> DataFrame:
    """Add `base`, and `spans`: base ones and those that the classifier adds."""
    based = with_base_spans(docs, text)
    if model is None:
        return based.withColumn("spans", F.col("base"))
    apart = lambda others: f"not exists({others}, o -> o.start < s.end and s.start < o.end)"
    accepted = f"transform(filter(candidates, s -> {_accepted(model)} and {apart('base')}), " \
               "s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end))"
    of = lambda kind: f"filter(a, s -> s.kind = '{kind}')"
    merged = bind(accepted, "a", bind(f"concat({of('secret')}, {of('number')})", "p", bind(
        f"filter({of('address')}, s -> {apart('p')})", "q",
        f"concat(base, p, q, filter({of('name')}, s -> {apart('p')} and {apart('q')}))",
    )))
    return computed_once(with_candidates(based, text), spans=F.expr(merged)).drop("candidates")


def joined(spans: str) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def redacted(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """`docs` with every span of the text replaced by its kind in brackets; overlaps are merged."""
    pieces = (
        "aggregate(array_sort(transform({0}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))), "
        "named_struct('at', 0L, 'out', ''), (a, s) -> if(s.end <= a.at, a, named_struct('at', s.end, 'out', "
        "concat(a.out, substr({1}, cast(a.at as int) + 1, cast(greatest(s.start - a.at, 0L) as int)), "
        "if(s.start >= a.at, concat('[', s.kind, ']'), '')))), "
        "a -> concat(a.out, substr({1}, cast(a.at as int) + 1)))"
    ).format(spans, f"coalesce(cast(`{text}` as string), '')")
    return docs.withColumn(text, F.expr(pieces))
