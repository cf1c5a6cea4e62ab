"""Secret scans: fixed patterns plus password guess cost.

Base spans come from three patterns. The method looks at values in a credential context (a name such
as password, pwd, auth or client_secret, then ``:`` or ``=``) and estimates how many guesses an attacker
needs: the cheapest segmentation of the value into known words, dates, repeats, keyboard walks, separators and
brute-force spans, found by dynamic programming. Values whose log10 of guesses reaches ``LEAST_GUESSES``
are further spans of kind ``guess``; a value that starts like a call, ``name(``, is code and none. A scan of the
whole column by a linear-time pattern decides which texts are looked at closely, so most texts never
become Python strings.

Words are ranked by two lists: the whole words of a public tokenizer's vocabulary in its order, and the
``MOST_WORDS`` words that stand in most documents of the corpus, without the last ones if they tie beyond that
number (``word_ranks`` counts all of it, leaving out what
stands in a credential context, so that a secret copied a thousand times does not become a word). A word of both
has its better rank. The two lists are what is broadcast: some ``MOST_WORDS`` plus the vocabulary's words.

Defined cases: null and empty texts have no spans; rows are answered one by one, repeated ones too; a
value of any length is judged, and a repeat or walk in it may be of any length; an empty table gives an empty result; columns whose names clash with added ones go.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowproof.llm.blocks import raw_texts, row_ranges
from rowproof.llm.common import with_fields
from rowproof.llm.packing import _tokenizer, tokenizer_path
from rowproof.session import cut

# The patterns of the scan, and the order of kinds.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

# Names of a credential context; those of ASSIGN are among them.
NAMES = (
    r"pass(?:word|wd|phrase|code)?", "pwd", "secret", "token", r"api[_-]?key", r"access[_-]?key",
    r"private[_-]?key", "auth", r"credentials?", "bearer",
)
# A name begins where no letter stands before it, or with a capital inside a camel-case name.
CONTEXT = (
    rf"""(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:{"|".join(NAMES)})"""
    r"""["']?[ \t]*[:=][ \t]*["']?([^\s"'<>,;]{6,})"""
)
CALL = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\(")
# What any match of the patterns above contains, built from the same names; RE2 scans for it.
TRIGGER = rf"(?i:{'|'.join(NAMES)})|AKIA[A-Z0-9]|[0-9a-f]{{{LEAST_HEX}}}"
LEAST_GUESSES = 10.0
LONGEST_WORD, PERIODS = 20, (1, 2, 3, 4)
SHORTEST_WORD, LEAST_DOCUMENTS, MOST_WORDS = 3, 2, 50_000
WORDS_AT_ONCE = 1 << 18  # distinct words that a task counts before it hands them on
SEPARATORS = frozenset("-_.:/+@#()")

COMMON = (
    "password pass admin root user login welcome letmein secret token test guest master default changeme hello "
    "monkey dragon shadow sunshine princess football baseball superman batman trustno iloveyou love summer winter "
    "spring autumn computer internet server database example sample demo foo bar baz abc qwerty none null true false "
    "key value name string text file path config private public access api auth service client account email "
    "the and for you are not with this that from have your please enter here required optional string placeholder"
).split()
_SEPARATOR = math.log10(len(SEPARATORS))
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
_LEET = str.maketrans("013457@$", "oieastas")


@cache
def known_words(path: str | None = None) -> dict[str, int]:
    """Rank of the common words, then of the whole words of a public tokenizer's vocabulary."""
    words = dict.fromkeys(COMMON)
    vocabulary = _tokenizer(path or tokenizer_path()).get_vocab()
    whole = (token[: -len("</w>")] for token in sorted(vocabulary, key=vocabulary.__getitem__) if token.endswith("</w>"))
    words.update(dict.fromkeys(w for w in whole if len(w) >= SHORTEST_WORD and w.isascii() and w.isalpha()))
    return {word: place for place, word in enumerate(words, 1)}


_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_ranks(
    documents: DataFrame, text: str = "text", most: int = MOST_WORDS, path: str | None = None
) -> dict[str, int]:
    """``known_words`` joined by the ``most`` words that stand in most documents of the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = _patterns()[3]
        found: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            words = [word for word in found if SHORTEST_WORD <= len(word) <= LONGEST_WORD]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([found[word] for word in words], pa.int64())], ["word", "n"]
            )
            found.clear()
            return batch

        for batch in batches:
            column = batch.column(0)
            data, offsets = raw_texts(column)
            content = data.tobytes()
            hits = set(pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(column, TRIGGER), False)).to_pylist())
            for row in range(len(column)):
                part = content[offsets[row] : offsets[row + 1]]
                if row in hits:
                    part = context.sub(" ", part.decode("utf-8", "replace")).encode()
                for word in set(part.translate(_LETTERS).split()):
                    found[word] = found.get(word, 0) + 1
                if len(found) > WORDS_AT_ONCE:
                    yield flush()
        yield flush()

    counted = cut(
        documents.select(F.col(f"`{text}`").cast("string"))
        .mapInArrow(count, "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= LEAST_DOCUMENTS)
    )
    # how many words stand in n documents: few different n, as large ones are rare
    least, taken = None, 0
    for row in counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).limit(most).collect():
        if taken + row["words"] > most:
            break
        least, taken = row["n"], taken + row["words"]
    found = []
    if least is not None:  # at most `most` words, so neither the driver nor a task gets more
        found = counted.where(F.col("n") >= least).collect()
        found.sort(key=lambda row: (-row["n"], bytes(row["word"])))
    ranks = dict(known_words(path))
    for place, row in enumerate(found, 1):
        word = bytes(row["word"]).decode("utf-8", "replace").lower()
        ranks[word] = min(place, ranks.get(word, place))
    return ranks


@cache
def _neighbours() -> frozenset[tuple[str, str]]:
    """Keys that stand side by side, in both directions."""
    pairs = [(a, b) for row in ROWS for a, b in zip(row, row[1:])]
    return frozenset(pairs + [(b, a) for a, b in pairs])


def _variety(value: str) -> int:
    """Size of the alphabet a brute-force search has to try."""
    size = 0
    for low, high, many in (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10)):
        size += many * any(low <= c <= high for c in value)
    if re.fullmatch(r"[0-9a-f]*[a-f][0-9a-f]*", value):
        size = 16
    return size + 33 * any(not c.isalnum() or ord(c) > 127 for c in value)


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``.

    Spans: a character by brute force, a separator, a known word (case and letter-like digits cost a little),
    a date, a character or group that repeats, a walk along keyboard neighbours. ``ranks``: of the known words.
    """
    ranks = known_words() if ranks is None else ranks
    lower = value.lower()
    plain = lower.translate(_LEET)
    if len(lower) != len(value):
        lower = plain = value
    beside = _neighbours()
    each = math.log10(max(_variety(value), 2))
    dates: dict[int, list[int]] = {}
    for start in range(len(value)):
        if value[start].isdigit() and (found := _DATE.match(value, start)):
            dates.setdefault(found.end(), []).append(start)
    best = [0.0] + [math.inf] * len(value)
    walk = 0  # start of the keyboard walk that ends here
    # per period: start of the repeat that ends here, and by remainder the starts that may still be cheapest
    since = dict.fromkeys(PERIODS, 0)
    starts: dict[tuple[int, int], list[int]] = {}
    for end in range(1, len(value) + 1):
        cost = best[end - 1] + (min(each, _SEPARATOR) if value[end - 1] in SEPARATORS else each)
        if end > 1 and (lower[end - 2], lower[end - 1]) not in beside:
            walk = end - 1
        if end - walk >= 3:
            cost = min(cost, best[walk] + math.log10(40 * 2 ** min(end - walk, 40)))
        for start in range(max(0, end - LONGEST_WORD), end - 2):
            rank = ranks.get(lower[start:end])
            extra = 0.0 if value[start:end] == lower[start:end] else 0.6
            if rank is None:
                rank, extra = ranks.get(plain[start:end]), extra + 0.6
            if rank is not None:
                cost = min(cost, best[start] + math.log10(rank + 1) + extra)
        for period in PERIODS:
            if end > period and value[end - 1] != value[end - 1 - period]:
                since[period] = end - period
                for rest in range(period):
                    starts.pop((period, rest), None)
            if end - 3 * period < since[period]:
                continue
            held = starts.setdefault((period, end % period), [])
            held.append(end - 3 * period)
            costs = [best[start] + math.log10((end - start) // period) for start in held]
            # an earlier start that costs no more now never will; a later one without a dearer beginning neither
            keep = [
                n for n, start in enumerate(held)
                if (n == 0 or costs[n] < min(costs[:n])) and best[start] < min((best[t] for t in held[n + 1 :]), default=math.inf)
            ]
            cost = min(cost, min(costs) + period * each)
            starts[period, end % period] = [held[n] for n in keep]
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + math.log10(365 * 120))
        best[end] = cost
    return best[-1]


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    # only ASCII letters in either case, as stated: no folding of other characters
    assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
    return assign, re.compile(ACCESS), re.compile(f"{HEX[:-1]}{{{LEAST_HEX},}}"), re.compile(CONTEXT, re.IGNORECASE | re.ASCII)


def find_secrets(text: str, ranks: dict[str, int] | None = None) -> list[tuple[int, int, str]]:
    """Sorted (start, end, kind) in code points; ``assign`` spans cover the whole match."""
    assign, access, digits, context = _patterns()
    found = []
    for match in assign.finditer(text):
        if len(match[2]) >= LEAST_ASSIGN:
            found.append((match.start(), match.end(), 0))
    for match in access.finditer(text):
        if match.end() - match.start() >= LEAST_ACCESS:
            found.append((match.start(), match.end(), 1))
    # maximal runs of at least LEAST_HEX are the same as all maximal runs without the shorter ones
    found += [(match.start(), match.end(), 2) for match in digits.finditer(text)]
    for match in context.finditer(text):
        if not CALL.match(match[1]) and guess_cost(match[1], ranks) >= LEAST_GUESSES:
            found.append((match.start(1), match.end(1), 3))
    return [(start, end, KINDS[kind]) for start, end, kind in sorted(found, key=lambda s: (s[0], s[2]))]


def _candidates(column: pa.Array, ranks: dict[str, int] | None = None) -> Iterator[tuple[int, list[tuple[int, int, str]]]]:
    """(row, spans) of the rows that have spans."""
    _, offsets = raw_texts(column)
    for start, end in row_ranges(offsets):
        part = column.slice(start, end - start)
        hits = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(part, TRIGGER), False))
        for row in hits.to_pylist():
            if spans := find_secrets(part[row].as_py(), ranks):
                yield start + row, spans


def _digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(documents: DataFrame, text: str = "text", ranks: dict[str, int] | None = None) -> DataFrame:
    """All columns of ``documents`` plus n_assign, n_access, n_hex, base_sha256 and spans; texts never move.

    ``ranks``: of known words; counted over ``documents`` if None.
    """
    shared = documents.sparkSession.sparkContext.broadcast(word_ranks(documents, text) if ranks is None else ranks)
    added = [T.StructField(name, T.LongType()) for name in ("n_assign", "n_access", "n_hex")]
    added += [T.StructField(name, T.StringType()) for name in ("base_sha256", "spans")]
    schema = with_fields(documents.schema, *added)
    kept = [field.name for field in schema][: -len(added)]
    place = documents.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = batch.num_rows
            counts = [[0] * rows for _ in range(3)]
            digests, spans = [none] * rows, [""] * rows
            for row, found in _candidates(batch.column(place), shared.value):
                base = [span for span in found if span[2] != "guess"]
                for kind in range(3):
                    counts[kind][row] = sum(span[2] == KINDS[kind] for span in base)
                digests[row] = hashlib.sha256(_digest(base).encode()).hexdigest()
                spans[row] = _digest(found)
            arrays = [batch.column(batch.schema.get_field_index(name)) for name in kept]
            arrays += [pa.array(count, pa.int64()) for count in counts]
            arrays += [pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    return documents.mapInArrow(scan, schema)


def mask(text: str, spans: list[tuple[int, int, str]], by: str = "[SECRET]") -> str:
    """``text`` with every maximal run of overlapping spans replaced."""
    pieces, at = [], 0
    for start, end, _ in spans:
        if start >= at or not pieces:
            pieces += [text[at:start], by]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def mask_secrets(
    documents: DataFrame, text: str = "text", length: str | None = None, ranks: dict[str, int] | None = None
) -> DataFrame:
    """``documents`` with secrets masked in ``text``; ``length`` names a column that counts code points."""
    shared = documents.sparkSession.sparkContext.broadcast(word_ranks(documents, text) if ranks is None else ranks)
    schema = with_fields(documents.schema)
    place = documents.columns.index(text)
    sized = documents.columns.index(length) if length in documents.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            new = {row: mask(column[row].as_py(), found) for row, found in _candidates(column, shared.value)}
            if new:
                batch = _replace(batch, place, new)
                if sized is not None:
                    batch = _replace(batch, sized, {row: len(value) for row, value in new.items()})
            yield batch

    return documents.mapInArrow(clean, schema)


def _replace(batch: pa.RecordBatch, place: int, new: dict[int, object]) -> pa.RecordBatch:
    column = batch.column(place)
    hit = pa.array([row in new for row in range(batch.num_rows)])
    values = pa.array([new[row] for row in sorted(new)]).cast(column.type)
    return batch.set_column(place, batch.schema.field(place), pc.replace_with_mask(column, hit, values))
