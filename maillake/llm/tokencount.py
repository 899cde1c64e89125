"""Token counts by heap-and-linked-list byte-pair merging.

A pre-split piece of text starts as one symbol for each byte, linked to its neighbours.  A
heap holds every adjacent pair that the vocabulary merges, by rank and then place.  The lowest
is popped and merged, which links two new pairs; an entry whose pair is gone by then is left
aside.  A piece has as many tokens as it had symbols, less its merges: no ids are made.

The tokenizer file (``tokenizers`` JSON, byte-level BPE) is read once on the driver and its bytes
travel with the task (size-checked).  Every worker builds the rank table once and remembers
the counts of short pieces, in a table that is emptied when full.

Splitting follows the library.  Its letters and digits are those of its own Unicode version, so
the driver asks it for the class of every code point; texts with a code point of which the
``regex`` module thinks differently are split by the library's own pre-tokenizer.  Special
strings in a text are one token each, as is the library's default.
"""

from __future__ import annotations

import json
from array import array
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from maillake.llm.bpe import pieces
from maillake.llm.common import process_cache, text_or_empty, tidy

MAX_FILE_BYTES = 64 << 20
REMEMBERED = 1 << 19            # pieces whose counts a worker keeps
SHORT = 48                      # characters of a piece worth remembering
LONG_PIECE = 1 << 12            # symbols from which packed arrays are used
PROBED = 1024                   # code points asked about at a time
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_tokenizer(path: str) -> bytes:
    """The file's bytes; refuses files too large to travel with a task and kinds it cannot count for."""
    with open(path, "rb") as f:
        data = f.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"{path}: tokenizer file above {MAX_FILE_BYTES} bytes")
    spec = json.loads(data)
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (model["type"] == "BPE" and not spec.get("normalizer") and not any(
        model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
    if not (plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", ())):
        raise ValueError(f"{path}: added tokens that take their surroundings")
    return data


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def disputed(split_by_library) -> str:
    """A character class of the code points that the library and the ``regex`` module class differently; '' if none.

    All code points in order make runs of one class.  Of a run that both split alike its first code point is
    probed, of the others every one: between two letters, two digits, two marks, and after a blank.
    """
    import regex

    ours = regex.compile(_SPLIT)

    def spans(text: str) -> tuple[set, set]:
        return {s for _, s in split_by_library(text)}, {m.span() for m in ours.finditer(text)}

    stands_for: dict[int, list[int]] = {}
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), PROBED):
        part = points[i:i + PROBED]
        theirs, own = spans("".join(map(chr, part)))
        for s, e in theirs & own:
            stands_for[part[s]] = part[s:e]
        for s, e in own - theirs:
            stands_for.update((c, [c]) for c in part[s:e])
    odd, asked = set(), sorted(stands_for)
    for before, after in (("\na", "a\n"), ("\n1", "1\n"), ("\n!", "!\n"), ("\n  ", "!\n")):
        width = len(before) + 1 + len(after)
        for i in range(0, len(asked), PROBED):
            part = asked[i:i + PROBED]
            theirs, own = spans("".join(before + chr(c) + after for c in part))
            for s, _ in theirs ^ own:
                odd.update(stands_for[part[min(s // width, len(part) - 1)]])
    out = []
    for c in sorted(odd):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out) + "]" if out else ""


class Counter:
    """Counts the tokens of texts; built once a process."""

    def __init__(self, data: bytes, odd: str):
        import re

        import regex
        from tokenizers import pre_tokenizers

        spec = json.loads(data)
        vocab, names = spec["model"]["vocab"], byte_names()
        self.first = [0] * 256
        for char, byte in names.items():
            self.first[byte] = vocab[char]
        self.rank, self.result = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            self.result.append(vocab[a + b])
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split = regex.compile(_SPLIT)
        self.odd = re.compile(odd) if odd else None
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.known: dict[str, int] = {}

    def text(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.special is None or self.special.search(text) is None:
            return self.ordinary(text)
        between = self.special.split(text)
        return len(between) - 1 + sum(map(self.ordinary, between))

    def ordinary(self, text: str) -> int:
        if self.odd is not None and not text.isascii() and self.odd.search(text):
            return sum(self.piece(text[s:e]) for _, (s, e) in self.library.pre_tokenize_str(text))
        known, total = self.known, 0
        for part in pieces(text):
            found = self.split.findall(part) if len(part) < 1 << 18 else (m.group() for m in self.split.finditer(part))
            for piece in found:
                n = known.get(piece)
                total += self.piece(piece) if n is None else n
        return total

    def piece(self, piece: str) -> int:
        """Tokens of one piece of the split."""
        octets = piece.encode()
        n = len(octets) - self.merges(octets)
        if len(piece) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = n
        return n

    def merges(self, octets: bytes) -> int:
        """How many pairs merge, lowest rank first, the leftmost first among equals."""
        n = len(octets)
        if n < 2:
            return 0
        pack = list if n < LONG_PIECE else lambda x: array("q", x)
        rank, result = self.rank, self.result
        symbol = pack(self.first[b] for b in octets)
        after, before = pack(range(1, n + 1)), pack(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(symbol[i] << 32 | symbol[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        heapify(heap)
        done = 0
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if symbol[i] < 0 or j >= n or rank.get(symbol[i] << 32 | symbol[j]) != r:
                continue
            symbol[i], symbol[j] = result[r], -1
            done += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(symbol[i] << 32 | symbol[k])
                if r is not None:
                    heappush(heap, r << 32 | i)
            k = before[i]
            if k >= 0:
                r = rank.get(symbol[k] << 32 | symbol[i])
                if r is not None:
                    heappush(heap, r << 32 | k)
        return done


def counter(data: bytes, odd: str) -> Counter:
    """The counter of this file, built once per process."""
    cache, key = process_cache(), f"token counter {hash(data)}"
    if key not in cache:
        cache[key] = Counter(data, odd)
    return cache[key]


def library_classes() -> str:
    """``disputed`` for the installed library, found once per process (a second or two)."""
    from tokenizers import pre_tokenizers

    cache = process_cache()
    if "disputed" not in cache:
        cache["disputed"] = disputed(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str)
    return cache["disputed"]


def count(df: DataFrame, tokenizer: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens`` (long) of every row, as the ``tokenizers`` library would count.

    Null and empty texts have 0 of both.  Ids may be null or repeated: repeated rows are counted
    once each.  Texts of any length are counted whole, in pieces; a piece without any place to
    split takes some 60 bytes of memory a byte.  Other columns are neither read nor returned,
    whatever their names.  An empty table gives an empty result.  One pass, no shuffle.
    """
    odd = library_classes()

    def run(batches):
        tokens = counter(tokenizer, odd)
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()),
                 pa.array([tokens.text(x.as_py()) for x in texts], pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    src = df.select(df[id_col], text_or_empty(df[text_col]).alias("__text"))
    return src.mapInArrow(tidy(run), f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
