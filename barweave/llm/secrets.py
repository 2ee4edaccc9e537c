"""Secret scan: base patterns, and a guess-cost dynamic programme over values in credential contexts."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import commonest, id_and_text, map_texts

KINDS = ("assign", "access", "hex", "guess")
#: Only where one of these is in the lower-cased text can ``assign`` match.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile(
    "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Greedy runs with a lower bound match what the unbounded run matches when that is long enough.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Credential contexts: a key word that ends in one of these, a separator, a value without white space. The words of
#: ``assign`` are among them, for values whose characters its pattern does not take.
CONTEXT_WORDS = (*_ASSIGN_WORDS, "pwd", "pass", "passphrase", "passcode", "credential", "credentials", "auth", "authorization", "login", "private_key", "access_key", "client_key", "bearer")
#: A key word follows no letter, or starts a part of an identifier (``dbPassword``). A value in quotes goes to its quote;
#: a scheme before a value (``Authorization: Bearer ...``) does not belong to it.
_SCHEME = r"(?:(?:Bearer|Basic|Token)\x20+)?"
_CONTEXT = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?:" + "|".join(map(_either_case, sorted(CONTEXT_WORDS, key=len, reverse=True))) + r""")["']?\x20*(?:[:=]|=>)\x20*"""
    + _SCHEME + r"""(?:"([^"\s]{6,})"|'([^'\s]{6,})'|["']?""" + _SCHEME + r"""([^\s"'<>,;]{6,}))"""
)
#: Addresses and paths of plain lower-case words are no secrets, however many guesses their words take.
_PATH = re.compile(r"(?:[a-z][a-z+.-]*+://)?[a-z._~-]*+(?:/[a-z._~-]*+)+")
_CONTEXT_HINT = re.compile("|".join(map(re.escape, CONTEXT_WORDS)))

#: Words that people choose, most common first; before the words that the corpus itself has.
COMMON_WORDS = (
    "password 123456 qwerty admin welcome letmein login master dragon monkey football baseball sunshine princess "
    "iloveyou shadow secret hello freedom whatever trustno1 superman batman summer winter spring autumn love "
    "test guest root user default changeme example sample token value string none null true false your my the "
    "and this that with from here enter insert please time year day world house computer internet company system "
    "server database network account private public service access manager office"
).split()
#: So many of the corpus' commonest words of DICTIONARY_SIZES letters are in the dictionary, by their rank.
DICTIONARY_WORDS, DICTIONARY_SIZES = 20_000, (3, 24)
#: Rows of a keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
#: How dates are written (YYYYMMDD, DDMMYYYY, MMDDYYYY with or without separators, a year alone).
DATES = tuple(re.compile(p) for p in (r"(?:19|20)[0-9]{2}([-/._]?)[0-9]{1,2}\1[0-9]{1,2}", r"[0-9]{1,2}([-/._]?)[0-9]{1,2}\1(?:19|20)[0-9]{2}", r"(?:19|20)[0-9]{2}"))
#: log10 of the cost of one more segment, of a brute-forced character, of how often a unit repeats, of a date.
SEGMENT_COST, CHARACTER_COST, REPEAT_COST, DATE_COST = 0.3, 1.0, 1.0, math.log10(365 * 120)
#: log10 of the cost of where a walk starts, of each of its steps, of each capital of a word (three at most).
WALK_START, WALK_STEP, CAPITAL_COST = math.log10(sum(map(len, KEY_ROWS))), 0.5, 0.3
MIN_REPEAT, MIN_WALK, MAX_UNIT, LONGEST_DATE = 3, 4, 8, 10


#: A-Z to a-z: what is looked up is as long as the value.
_LOWER = {c: c + 32 for c in range(65, 91)}


def _adjacent(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


class GuessCosts:
    """Guess costs under a dictionary: words with their ranks.

    A segment is a word of the dictionary; a date; a unit of 1 to MAX_UNIT characters that repeats (one character
    MIN_REPEAT times, others twice at least, the last time may be cut short); a walk of MIN_WALK keys or more, each
    next to the one before; or any characters by brute force. Each segment after the first costs SEGMENT_COST more.
    The minimum is over all segmentations. It is linear in the length: of all starts that a repeat, a walk or a
    brute-force segment to a place can have, only the cheapest matters, and that is carried along."""

    def __init__(self, words: list[str] | tuple[str, ...] = ()):
        self.rank: dict[str, int] = {}
        for word in (*COMMON_WORDS, *words):
            self.rank.setdefault(word, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))
        self.heads = {w[:3] for w in self.rank}
        self.short = lru_cache(maxsize=20_000)(self.whole)

    def __call__(self, value: str) -> float:
        """log10 of the guesses for the cheapest segmentation of the whole value."""
        return self.short(value) if len(value) <= 256 else self.whole(value)

    def word_cost(self, value: str) -> float | None:
        """The cost of a segment as a word; None if it is none."""
        rank = self.rank.get(value.translate(_LOWER))
        return None if rank is None else math.log10(rank + 1) + CAPITAL_COST * min(3, sum("A" <= c <= "Z" for c in value))

    def whole(self, value: str) -> float:
        n, low = len(value), value.translate(_LOWER)
        best = [math.inf] * (n + 1)  # the cheapest way to each place
        best[0] = 0.0
        brute = math.inf  # the cheapest way here that ends in brute force
        walked, walk = 0, math.inf  # keys side by side up to here; the cheapest start of a walk, less its steps
        matched = [0] * (MAX_UNIT + 1)  # characters up to here that equal those a unit before
        repeat = [math.inf] * (MAX_UNIT + 1)  # the cheapest start of a repeat of each unit
        for j in range(1, n + 1):
            i, c = j - 1, low[j - 1]
            begun = best[i] + (SEGMENT_COST if i else 0.0)
            if low[i : i + 3] in self.heads:  # words that start here
                for end in range(i + 3, min(n, i + self.longest) + 1):
                    if low[i:end] in self.rank:
                        best[end] = min(best[end], begun + self.word_cost(value[i:end]))
            brute = min(brute, begun) + CHARACTER_COST
            least = min(best[j], brute)
            if walked and _adjacent(low[i - 1], c):
                walked += 1
            else:
                walked, walk = int(c in _PLACE), math.inf
            if walked >= MIN_WALK:
                start = j - MIN_WALK
                walk = min(walk, best[start] + (SEGMENT_COST if start else 0.0) - WALK_STEP * start)
                least = min(least, walk + WALK_START + WALK_STEP * j)
            for unit in range(1, min(MAX_UNIT, i) + 1):
                if c != low[i - unit]:
                    matched[unit], repeat[unit] = 0, math.inf
                    continue
                matched[unit] += 1
                needed = unit if unit > 1 else MIN_REPEAT - 1
                if matched[unit] >= needed:
                    start = j - needed - unit
                    repeat[unit] = min(repeat[unit], best[start] + (SEGMENT_COST if start else 0.0))
                    least = min(least, repeat[unit] + CHARACTER_COST * unit + REPEAT_COST)
            if "0" <= c <= "9":
                for start in range(max(0, j - LONGEST_DATE), j - 3):
                    cost = best[start] + (SEGMENT_COST if start else 0.0) + DATE_COST
                    if cost < least and is_date(low[start:j]):
                        least = cost
            best[j] = least
        return best[n]


def is_date(text: str) -> bool:
    return any(p.fullmatch(text) for p in DATES)


def is_walk(text: str) -> bool:
    low = text.translate(_LOWER)
    return len(low) >= MIN_WALK and all(map(_adjacent, low, low[1:]))


def is_repeat(text: str, unit: int) -> bool:
    low = text.translate(_LOWER)
    return len(low) >= (2 * unit if unit > 1 else MIN_REPEAT) and low[unit:] == low[:-unit]


def find_spans(text: str, min_cost: float, guess_cost: GuessCosts) -> tuple[list[tuple[int, int, int]], list[float]]:
    """All spans (start, kind index, end) in order; the guess costs of the base ``assign`` values."""
    found: list[tuple[int, int, int]] = []
    costs: list[float] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                found.append((m.start(), 0, m.end()))
                costs.append(guess_cost(m[2]))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    if _CONTEXT_HINT.search(low):
        starts, ends, reach = [], [], 0  # of the base spans, in order, with how far they reach
        for s, _, e in found:
            reach = max(reach, e)
            starts.append(s), ends.append(reach)
        for m in _CONTEXT.finditer(text):
            s, e = m.span(m.lastindex)
            before = bisect_left(starts, e)
            if before:  # what base spans cover is theirs
                s = max(s, ends[before - 1])
            if e - s >= 6 and not _PATH.fullmatch(text, s, e) and guess_cost(text[s:e]) >= min_cost:
                found.append((s, 3, e))
    return sorted(found), costs


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY_WORDS) -> list[str]:
    """The commonest words of running text, at most ``most``, over all documents, the commonest first. A word is letters
    a-z with at most the first one capital, a space before them that no colon or equals sign precedes, so that values in
    credential contexts do not make themselves words. Only counts are shuffled."""
    few, many = DICTIONARY_SIZES
    pattern = rf"(?<=[^:=\x20]\x20)[A-Za-z][a-z]{{{few - 1},{many - 1}}}(?![A-Za-z0-9_=:/+-])"
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(pattern), F.lit(0))).alias("w"))
    return [w for w, _ in commonest(words.groupBy(F.lower("w").alias("w")).count(), "w", "count", most)]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = 10.0, dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """One row per row of ``docs`` with its secret spans.

    Base kinds ``assign``, ``access`` and ``hex`` come from the patterns alone. Values in credential
    contexts become ``guess`` spans if their cheapest segmentation takes at least 10**min_cost guesses, unless they are
    paths of plain words; values are judged whole, whatever their length, but for what base spans cover up to their last
    end. The dictionary is a list of common words and the corpus' own ``dictionary_words`` commonest ones, so that the
    other rows have a part in what is guessed. ``max_cost`` is the largest guess cost among the ``assign``
    values (null if none).

    A null text counts as empty: no spans, base_sha256 of the empty string. Texts of any length are scanned whole, in
    time linear in their length. Repeated rows each give a row; a null id is kept; other columns of ``docs`` are
    ignored; an empty table gives no rows. Offsets are code points, the end exclusive. Texts are not shuffled.
    """
    words = docs.sparkSession.sparkContext.broadcast(corpus_words(docs, text_col, dictionary_words))

    def judge():
        guess_cost = GuessCosts(words.value)

        def one(texts):
            rows = []
            for text in texts:
                spans, costs = find_spans(text or "", min_cost, guess_cost)
                names = [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]
                base = [x for x, (_, k, _) in zip(names, spans) if k < 3]
                count = [sum(k == i for _, k, _ in spans) for i in range(4)]
                rows.append((*count[:3], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(names), count[3], max(costs, default=None)))
            return rows

        return one

    columns = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_cost double"
    return map_texts(id_and_text(docs, id_col, text_col), columns, judge)
