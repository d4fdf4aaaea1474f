"""Token counts by byte-pair merging, without making tokens.

A word's symbols stand in a linked list; all adjacent pairs that a rule merges lie in a heap by (rank, place). The
lowest is popped over and over: if its two symbols still stand there, the right one joins the left one and the two new
neighbour pairs are pushed. The count is the initial symbols less the merges; no identifiers are made or looked up.
Merging takes n log n steps for a word of n symbols, however long it is.

The vocabulary is the JSON file of a byte-level model: its normalizers, its splitting pattern, its merges and its added
tokens are read once in the driver and broadcast (48,894 merges take some MB; files beyond ``MOST_BYTES`` are refused).
Words recur, so each worker remembers the counts of up to ``MEMO`` short words.

Edge cases: null and empty texts have no bytes and no tokens; strings of added tokens inside a text are one token each,
as the tokenizers library takes them by default; a text that is one word of millions of letters is merged whole; rows are
counted one by one, so repeated rows, null ids and empty tables need no care; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import ship

LIMIT = 2048
MEMO, MEMO_WORD = 1 << 20, 64
MOST_BYTES = 64 << 20
#: How byte-level models split words where they have no pattern of their own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters whose lower case depends on the word in Python, or is newer than its tables.
_LOWER = (("Σ", "σ"), ("\ua7cb", "\u0264"), ("\ua7dc", "\u019b"))
#: White space as Unicode has it; the regex module would add the separators U+001C to U+001F.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def byte_symbols() -> list[str]:
    """The printable character that byte-level models write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, 0x100
    for b in range(256):
        out[b] = chr(b) if b in shown else chr(free)
        free += b not in shown
    return out


def number_merges(merges: list[tuple[str, str]], ends: str) -> tuple[dict[str, int], dict[int, int], list[int]]:
    """Small numbers for the symbols; for each pair (left << 20 | right) its rank << 32; and by rank the joined symbol."""
    number: dict[str, int] = {}
    for c in byte_symbols():
        number.setdefault(c, len(number))
        number.setdefault(c + ends, len(number))
    pairs, joined = {}, []
    for rank, (a, b) in enumerate(merges):
        a, b, c = (number.setdefault(x, len(number)) for x in (a, b, a + b))
        pairs[a << 20 | b] = rank << 32
        joined.append(c)
    return number, pairs, joined


def count_merged(symbols: list[int], pairs: dict[int, int], joined: list[int]) -> int:
    """How many of ``symbols`` are left once all merges are done, the lowest rank first, the leftmost of equals first."""
    n = left = len(symbols)
    after, before, found = [*range(1, n), -1], [*range(-1, n - 1)], pairs.get
    heap = [rank | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (rank := found(a << 20 | b)) is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        j = after[i]
        # where a symbol was merged away (-1) or has grown, the pair there has another rank or none
        if j < 0 or found(symbols[i] << 20 | symbols[j]) != top ^ i:
            continue
        symbols[i] = to = joined[top >> 32]
        symbols[j] = -1
        after[i] = k = after[j]
        left -= 1
        if k >= 0:
            before[k] = i
            if (rank := found(to << 20 | symbols[k])) is not None:
                heappush(heap, rank | i)
        if (h := before[i]) >= 0 and (rank := found(symbols[h] << 20 | to)) is not None:
            heappush(heap, rank | h)
    return left


def read_vocabulary(path: str, most_bytes: int = MOST_BYTES) -> dict:
    """What counting needs of a tokenizer's JSON file; a ValueError if it asks for what is not done here."""
    if Path(path).stat().st_size > most_bytes:
        raise ValueError(f"{path} is larger than {most_bytes} bytes")
    made = json.loads(Path(path).read_text(encoding="utf-8"))
    model = made["model"]
    if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
        raise ValueError("only plain byte-pair models are counted")

    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]

    normal = []
    for s in steps(made.get("normalizer"), "normalizers"):
        if s["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase"):
            normal.append((s["type"],))
        elif s["type"] == "Replace":
            pattern = s["pattern"].get("Regex") or regex.escape(s["pattern"]["String"])
            normal.append(("Replace", pattern, s["content"]))
        else:
            raise ValueError(f"normalizer {s['type']}")
    split, level = None, None
    for s in steps(made.get("pre_tokenizer"), "pretokenizers"):
        if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and level is None and split is None:
            split = s["pattern"]["Regex"]
        elif s["type"] == "ByteLevel" and not s["add_prefix_space"] and not (split and s.get("use_regex", True)):
            level = True
            split = split or BYTE_LEVEL
        else:
            raise ValueError(f"pre-tokenizer {s['type']}")
    if not level:
        raise ValueError("only byte-level models are counted")
    ends = model.get("end_of_word_suffix") or ""
    missing = [c for c in byte_symbols() if c not in model["vocab"] or c + ends not in model["vocab"]]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} byte symbols")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in made["added_tokens"]):
        raise ValueError("added tokens with rules of their own are not counted")
    return {"normal": normal, "split": split, "ends": ends, "merges": merges, "added": [t["content"] for t in made["added_tokens"]]}


class _Memo(dict):
    """Counts by word, forgotten as a whole once there are ``MEMO``; long words are counted each time."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= MEMO_WORD:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


class Counter:
    """Counts the tokens of texts by one vocabulary."""

    def __init__(self, vocabulary: dict):
        own = lambda p: regex.compile(p.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        # runs of white space to one space: a single space stays as it is, and few runs are anything else
        runs = re.compile(f" [{SPACE}]+|[{SPACE.replace(' ', '')}][{SPACE}]*")
        self.normal = [s if s[0] != "Replace" else (s[0], runs if s[1:] == (r"\s+", " ") else own(s[1]), s[2]) for s in vocabulary["normal"]]
        self.words = own(vocabulary["split"]).findall
        added = sorted((t for t in vocabulary["added"] if t), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        number, self.pairs, self.joined = number_merges(vocabulary["merges"], vocabulary["ends"])
        self.inner = [number[c] for c in byte_symbols()]
        self.last = [number[c + vocabulary["ends"]] for c in byte_symbols()]
        self.memo = _Memo(self.word)

    def word(self, word: str) -> int:
        data = word.encode()
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        return count_merged(symbols, self.pairs, self.joined)

    def normalised(self, text: str) -> str:
        for kind, *rest in self.normal:
            if kind == "Replace":
                text = rest[0].sub(lambda _, to=rest[1]: to, text)
            elif kind == "Lowercase":  # letter by letter: a sigma at a word's end is no other letter
                for upper, lower in _LOWER:
                    text = text.replace(upper, lower)
                text = text.lower()
            elif not unicodedata.is_normalized(kind, text):
                text = unicodedata.normalize(kind, text)
        return text

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.added.split(text) if self.added else [text]
        found = len(parts) - 1
        for part in parts:
            found += sum(map(self.memo.__getitem__, self.words(self.normalised(part))))
        return found


#: The counters of a Python worker, by their vocabulary, so that its later tasks find words counted.
_COUNTERS: dict[str, Counter] = {}


def _counter(digest: str, vocabulary: dict) -> Counter:
    if digest not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[digest] = Counter(vocabulary)
    return _COUNTERS[digest]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), for each row.

    ``vocabulary`` is the path of the JSON file, read in the driver alone.
    """
    spark = docs.sparkSession
    ship(spark)
    made = read_vocabulary(vocabulary)
    shared, digest = spark.sparkContext.broadcast(made), xxhash.xxh3_128_hexdigest(repr(made))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(digest, shared.value)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(1)]
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], ["_row", "n_bytes", "n_tokens", "over_limit"])

    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return rows.mapInArrow(run, schema).select("_row.*", "n_bytes", "n_tokens", "over_limit")
