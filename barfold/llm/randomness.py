"""Secret scans: fixed patterns, and a battery of randomness tests over strings that look encoded.

Patterns find assigned secrets, access keys and long hex runs. Beyond them, a candidate is a maximal run of at least
LEAST letters, digits, + / _ - and up to two =, with at least one letter. Its alphabet is inferred (hex, one case, base 32,
base 36, both cases, base 64) and three tests ask whether it could be drawn evenly from it:

* chi-squared for even use of the alphabet, in either direction (a sequence is too even);
* runs above and below the alphabet's middle (Wald-Wolfowitz);
* serial correlation of neighbouring characters.

Each gives a two-sided normal p-value (chi-squared through Wilson and Hilferty's cube root); the candidate's is three
times the least. All candidates of a length band, letters alone apart from others, are then taken together:
Benjamini-Hochberg at level FALSE_SHARE declares those not random whose p-values are too small for their band. This
bounds the random strings that are lost.

Plain strings that are reported are bounded from the other side: a candidate is also held against a model of ordinary
names (letters as often as in text, and runs of one case, of digits or of signs). How much likelier an even draw makes it
than the model is an e-value; by the e-value form of Benjamini-Hochberg, at most FALSE_SECRETS of what a band reports
is expected to be plain by the model. So a string is a secret if it is too random for a name and not too uneven to be
random. Bands keep the many short strings from setting the bound for the long ones. Only built-in functions are used.

The procedures need values of the whole table only as counts for each band and step, so at most a few thousand sums reach
the driver, and a second pass over the texts marks the spans. No text is shuffled.

Defined cases: a null or empty text has no spans; repeated rows are rows of their own; an empty table gives an empty
one; positions are code points, ends exclusive; input columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns, the group that is measured and its least length.
PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
LEAST = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
KINDS = [*(p[0] for p in PATTERNS), "random"]
#: Encodings, the narrowest first: name, pattern of all characters, alphabet in order.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = [
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", r"^[a-z]+$", _LOWER),
    ("UPPER", r"^[A-Z]+$", _UPPER),
    ("base32", r"^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", r"^[a-z0-9]+$", _DIGITS + _LOWER),
    ("BASE36", r"^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("both", r"^[A-Za-z]+$", _UPPER + _LOWER),
    ("base64", r"^.*$", _UPPER + _LOWER + _DIGITS + "+/-_"),
]
#: Share of even strings that may be declared not random, and of reported strings that may be plain.
FALSE_SHARE, FALSE_SECRETS = 0.01, 0.05
#: Upper ends of length bands, and steps for each power of ten of the p-value, down to 1e-30.
BANDS = [19, 24, 32, 40, 64, 128]
P_STEPS, P_LEAST = 20, 30
#: Steps of the natural logarithm of e-values, and its largest step.
E_STEPS, E_MOST = 4, 400

#: Letters of English text in per cent, a to z.
LETTERS = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074]
#: Chances in a name that a lower-case letter, a capital, a digit, a sign (rows) is followed by one of these (columns).
FOLLOWS = [[0.88, 0.05, 0.03, 0.04], [0.5, 0.4, 0.05, 0.05], [0.1, 0.1, 0.7, 0.1], [0.5, 0.3, 0.15, 0.05]]


@dataclass(frozen=True)
class Levels:
    """By band: steps of p-values that are declared not random, and the first step of e-values that are not plain."""

    refused: list[int]
    strange: list[int]


def _matches(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches: array of (start, end, match), in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # One more gap than matches: the last pair has a null match.
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap")))

    def step(done: Column, pair: Column) -> Column:
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) + pair["gap"]
        one = F.struct(start.alias("start"), (start + F.length(pair["match"])).alias("end"), pair["match"].alias("match"))
        return F.when(pair["match"].isNull(), done).otherwise(F.concat(done, F.array(one)))

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(text.rlike(pattern), F.aggregate(pairs, none, step)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns: array of (start, end, kind as its number), in no order."""
    def of(number: int) -> Column:
        _, pattern, group, least = PATTERNS[number]
        spans = _matches(text, pattern)
        if group:
            spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["match"], pattern, group)) >= least)
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    return F.concat(*[of(number) for number in range(len(PATTERNS))])


def candidates(text: Column) -> Column:
    """Strings that look encoded: array of (start, end, match)."""
    return _matches(text, CANDIDATE)


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _two_sided(z: Column) -> Column:
    """Two-sided normal p-value: Abramowitz and Stegun's rational tail (7.1.26), good to 1e-7, at least 1e-30."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(F.lit(10.0**-P_LEAST), poly * F.exp(-x * x))


def p_value(match: Column) -> Column:
    """Chance that a string drawn evenly from its alphabet looks so uneven: three times the least of the battery."""
    body = F.rtrim(F.translate(match, "=", " "))
    of = F.lit(len(ENCODINGS) - 1)
    for k in reversed(range(len(ENCODINGS) - 1)):
        of = F.when(body.rlike(ENCODINGS[k][1]), F.lit(k)).otherwise(of)
    alphabet = F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), of + 1)
    # + and - share a value in base 64, as do / and _: 64 characters in all.
    letters = F.when(of == len(ENCODINGS) - 1, F.lit(64.0)).otherwise(F.length(alphabet).cast("double"))
    chars = F.split(F.translate(body, "-_", "+/"), "")

    def least(chars: Column, letters: Column, values: Column) -> Column:
        n = F.size(chars).cast("double")
        worst = F.greatest(*[F.abs(z) for z in (_evenness(chars, n, letters), _runs(values, n, letters), _serial(values, n, letters))])
        return F.least(F.lit(1.0), 3 * _let(worst, _two_sided))

    def placed(chars: Column, alphabet: Column) -> Column:
        return F.transform(chars, lambda c: (F.call_function("position", c, alphabet) - 1).cast("double"))

    return _let(chars, lambda cs: _let(letters, lambda ls: _let(alphabet, lambda a: _let(placed(cs, a), lambda vs: least(cs, ls, vs)))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _evenness(chars: Column, n: Column, letters: Column) -> Column:
    """Normal score of chi-squared over the alphabet."""
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    chi = letters / n * _total(F.transform(counts, lambda x: x * x)) - n
    free = letters - 1
    spread = 2 / (9 * free)
    return (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)


def _pairs(values: Column, f) -> Column:
    """f of each value and the next."""
    n = F.size(values)
    return F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), f)


def _runs(values: Column, n: Column, letters: Column) -> Column:
    """Normal score of the number of runs in the upper and lower half of the alphabet."""

    def score(upper: Column, mean: Column) -> Column:
        runs = 1 + _total(_pairs(upper, lambda x, y: (x != y).cast("double")))
        spread = (mean - 1) * (mean - 2) / (n - 1)
        # All in one half: as unlikely as the coin throws that it takes.
        return F.when(spread > 0, (runs - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.sqrt(n))

    def expected(upper: Column) -> Column:
        return _let(_total(F.transform(upper, lambda u: u.cast("double"))), lambda above: 2 * above * (n - above) / n + 1)

    return _let(F.transform(values, lambda v: v >= letters / 2), lambda up: _let(expected(up), lambda mean: score(up, mean)))


def _serial(values: Column, n: Column, letters: Column) -> Column:
    """Normal score of the correlation of neighbours, about the alphabet's own mean and spread."""
    mean, variance = (letters - 1) / 2, (letters * letters - 1) / 12
    return _total(_pairs(values, lambda x, y: (x - mean) * (y - mean))) / variance / F.sqrt(n - 1)


def strangeness(match: Column) -> Column:
    """Logarithm of how much likelier an even draw from the string's alphabet makes it than the model of names."""
    body = F.rtrim(F.translate(match, "=", " "))
    size = F.lit(64.0)
    for _, pattern, alphabet in reversed(ENCODINGS[:-1]):
        size = F.when(body.rlike(pattern), F.lit(float(len(alphabet)))).otherwise(size)
    total = sum(LETTERS)
    letter = F.array(*[F.lit(math.log(x / total)) for x in LETTERS])
    follows = F.array(*[F.lit(math.log(x)) for row in FOLLOWS for x in row])

    def kind(c: Column) -> Column:
        return F.when((c >= "a") & (c <= "z"), 0).when((c >= "A") & (c <= "Z"), 1).when((c >= "0") & (c <= "9"), 2).otherwise(3)

    def emitted(c: Column) -> Column:
        at = F.call_function("position", F.lower(c), F.lit(_LOWER))
        digit = (c >= "0") & (c <= "9")
        return F.when(at > 0, F.try_element_at(letter, at)).when(digit, F.lit(math.log(0.1))).otherwise(F.lit(math.log(0.25)))

    def plain(chars: Column) -> Column:
        def moves(kinds: Column) -> Column:
            return _total(_pairs(kinds, lambda x, y: F.element_at(follows, 4 * x + y + 1)))

        return _let(F.transform(chars, kind), moves) + _total(F.transform(chars, emitted)) + math.log(0.25)

    return _let(F.split(body, ""), lambda chars: -F.size(chars) * F.ln(size) - plain(chars))


def _band(match: Column) -> Column:
    """Length band; those of letters alone come after the others."""
    out = F.lit(len(BANDS))
    for k in reversed(range(len(BANDS))):
        out = F.when(F.length(match) <= BANDS[k], F.lit(k)).otherwise(out)
    return out + F.when(match.rlike("[^A-Za-z]"), 0).otherwise(len(BANDS) + 1)


def _step(p: Column) -> Column:
    """p-values by steps, the smallest first; a step's values are at most 10 ** ((step + 1) / P_STEPS - P_LEAST)."""
    return F.greatest(F.lit(0), F.least(F.lit(P_STEPS * P_LEAST - 1), F.floor((F.log10(p) + P_LEAST) * P_STEPS).cast("int")))


def _e_step(e: Column) -> Column:
    """Logarithms of e-values by steps, the smallest first; a step's values are at least step / E_STEPS, from step 1 on."""
    return F.greatest(F.lit(0), F.least(F.lit(E_MOST), F.floor(e * E_STEPS).cast("int")))


def refused_steps(counts: dict[int, int]) -> int:
    """The number of steps of p-values that are declared not random (Benjamini-Hochberg)."""
    total, seen, refused = sum(counts.values()), 0, 0
    for step in sorted(counts):
        seen += counts[step]
        if 10.0 ** ((step + 1) / P_STEPS - P_LEAST) * total <= FALSE_SHARE * seen:
            refused = step + 1
    return refused


def strange_step(counts: dict[int, int]) -> int:
    """The first step of e-values that are not plain: those at least total / (FALSE_SECRETS * number of them)."""
    total, seen, first = sum(counts.values()), 0, E_MOST + 1
    for step in sorted(counts, reverse=True):
        seen += counts[step]
        if step and step / E_STEPS >= math.log(total / (FALSE_SECRETS * seen)):
            first = step
    return first


def levels(df: DataFrame, text: str = "text") -> Levels:
    """The levels of all candidates of a table."""
    found = df.select(F.explode(candidates(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("c")).select("c.match")
    both = F.array(F.struct(F.lit(0).alias("kind"), _step(p_value(F.col("match"))).alias("step")), F.struct(F.lit(1).alias("kind"), _e_step(strangeness(F.col("match"))).alias("step")))
    steps = found.select(_band(F.col("match")).alias("band"), F.explode(both).alias("s")).select("band", "s.*")
    counts: list[list[dict[int, int]]] = [[{}, {}] for _ in range(2 * len(BANDS) + 2)]
    for r in steps.groupBy("band", "kind", "step").agg(F.count("*").alias("n")).collect():  # at most bands x steps
        counts[r.band][r.kind][r.step] = r.n
    return Levels([refused_steps(p) for p, _ in counts], [strange_step(e) for _, e in counts])


def scan(df: DataFrame, text: str = "text", known: Levels | None = None) -> DataFrame:
    """Append secrets: array of (start, kind, end) in order; kind is its number in KINDS. Random spans that overlap a
    fixed pattern's are left out. known: levels() of a corpus, else of df."""
    known = levels(df, text) if known is None else known
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    limit, strange = (F.array(*[F.lit(x) for x in some]) for some in (known.refused, known.strange))
    kept = [c for c in df.columns if c.lower() not in ("secrets", "_base", "_seen")]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], base_spans(body).alias("_base"), candidates(body).alias("_seen"))

    def apart(s: Column) -> Column:
        return ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def random(s: Column) -> Column:
        band = _band(s["match"]) + 1
        even = _step(p_value(s["match"])) >= F.element_at(limit, band)
        return (_e_step(strangeness(s["match"])) >= F.element_at(strange, band)) & even

    chosen = F.filter(F.filter("_seen", apart), random)
    spans = F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), s["end"].alias("end")))
    return rows.withColumn("secrets", F.array_sort(F.concat("_base", spans))).drop("_base", "_seen")


def redact(text: Column, secrets: Column) -> Column:
    """The text with each secret span replaced by its kind in brackets; overlapping spans by that of the first."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("pos"))
    kind = F.array(*[F.lit(k) for k in KINDS])

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["pos"]
        added = F.concat(state["done"], F.substring(text, state["pos"] + 1, s["start"] - state["pos"]), F.lit("["), F.element_at(kind, s["kind"] + 1), F.lit("]"))
        return F.struct(F.when(fresh, added).otherwise(state["done"]).alias("done"), F.greatest(state["pos"], s["end"]).alias("pos"))

    return F.when(F.size(secrets) > 0, F.aggregate(secrets, start, step, lambda e: F.concat(e["done"], F.substring(text, e["pos"] + 1, F.length(text))))).otherwise(text)
