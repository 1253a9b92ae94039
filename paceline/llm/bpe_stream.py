"""BPE encoding and decoding as streaming transducers with bounded lookahead.

Encoding.  A merge list has a sufficient lookahead: a number L of symbols such
that the tokens which end L symbols before the end of what has been read are the
same whatever follows.  L is computed from the merges (see `lookahead`).  A word
is read in blocks; once a block is merged, its stable tokens are emitted and only
the rest is kept, so memory stays constant however long a word or text is.
Since no merge crosses the border of a stable token, what follows is encoded as
if it stood alone.  Words seen before come from a cache of fixed size.

Decoding.  A state machine turns tokens into bytes and bytes into text, keeping
the bytes of an unfinished character for the next call.

The tokenizer is a `tokenizers` JSON file whose path is a parameter: a BPE model
with a byte-level alphabet and an end-of-word suffix, NFC, white space and lower
case normalization, and a split into contractions, letters, single digits and
other signs.  Ids and decoded text equal that library's.

Defined cases: null and empty texts have no tokens and decode to empty text;
special tokens' strings in a text are those tokens, as in the library; equal
texts get equal ids, repeated rows too, whatever their doc_id; equal ranks don't
occur, of equal places the leftmost merges first; very long texts and words take
constant memory; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text that are fed at a time.
SLICE = 1 << 16
#: A word of more characters is encoded while it is still being read (at least 4, so never a contraction).
LONG_WORD = 1 << 12
#: Words that the cache holds before it is emptied.
CACHE_WORDS = 1 << 19
#: Longest word (bytes) that is cached.
CACHE_BYTES = 64

# White space and word patterns of the tokenizer file's kind.
_WHITE = r"\t\n\x0B\f\r \x85\xA0  -     　"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_UNUSED = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
_RUNS = (regex.compile(r"\p{L}*+"), regex.compile(rf"[^{_WHITE}\p{{L}}\p{{N}}]*+"))
_LETTER = regex.compile(r"\p{L}")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _composing() -> frozenset[str]:
    """Characters of class 0 that canonical composition may join to the one before."""
    seconds = set(map(chr, range(0x1161, 0x11C3)))
    for c in range(0xA0, 0x20000):
        d = unicodedata.decomposition(chr(c))
        if d and d[0] != "<" and " " in d:
            seconds.add(chr(int(d.split()[1], 16)))
    return frozenset(x for x in seconds if unicodedata.combining(x) == 0)


class Merges:
    """Vocabulary, merges by rank, and the lookahead that they need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if (spec["normalizer"], spec["pre_tokenizer"]) != (_NORMALIZER, _PRE_TOKENIZER) or model["type"] != "BPE" or any(model.get(x) for x in _UNUSED):
            raise ValueError(f"{path}: another normalization, split or kind of BPE than this encoder's")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = max([*self.vocab.values(), *self.specials.values()]) + 1
        self.rank: dict[int, tuple[int, int]] = {}
        for n, (a, b) in enumerate(pairs):
            key = self.vocab[a] * self.size + self.vocab[b]
            self.rank.setdefault(key, (n, self.vocab[a + b]))
        symbols = byte_symbols()
        self.inner = [self.vocab.get(x, -1) for x in symbols]
        self.last = [self.vocab.get(x + self.suffix, -1) for x in symbols]
        self.surface = [b""] * self.size
        for word, i in {**self.vocab, **self.specials}.items():
            self.surface[i] = word.encode()
        self.lookahead = lookahead([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs], self.size)

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the merges, lowest rank first and leftmost first, to a short list."""
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, size = self.rank, self.size
        ids = list(ids)
        while len(ids) > 1:
            best, at, new = 1 << 60, -1, 0
            a = ids[0]
            for k in range(1, len(ids)):
                b = ids[k]
                got = rank.get(a * size + b)
                if got is not None and got[0] < best:
                    best, at, new = got[0], k - 1, got[1]
                a = b
            if at < 0:
                break
            ids[at : at + 2] = [new]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, size, n = self.rank, self.size, len(ids)
        ids = list(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(got[0], k, ids[k], ids[k + 1], got[1]) for k in range(n - 1) if (got := rank.get(ids[k] * size + ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k] if ids[k] >= 0 else n
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if got := rank.get(new * size + ids[after[k]]):
                    heapq.heappush(heap, (got[0], k, new, ids[after[k]], got[1]))
            if before[k] >= 0:
                i = before[k]
                if got := rank.get(ids[i] * size + new):
                    heapq.heappush(heap, (got[0], i, ids[i], new, got[1]))
        return [x for x in ids if x >= 0]


def lookahead(merges: list[tuple[int, int, int]], size: int) -> int:
    """Symbols of lookahead that are enough for a list of (left, right, result) by rank.

    Take two texts that agree up to a place and are merged side by side.  Where
    their tokens first differ moves left only when a merge (t, s) happens in one
    of them and s begins at that place.  The merge that put it there had a left
    part u that s still begins with (s, its left part, the left part of that ...)
    and a lower rank.  So the furthest reach of (t, s) is |t| plus the furthest
    reach of such u, or |t| + |s| where the texts themselves differ inside s; one
    pass in rank order gives the largest.
    """
    length, left, reach = [1] * size, [-1] * size, [0] * size
    most = 1
    for t, s, new in merges:
        far, u = length[s], s
        while u >= 0:
            far = max(far, reach[u])
            u = left[u]
        far += length[t]
        reach[t] = max(reach[t], far)
        most = max(most, far)
        if left[new] < 0:
            left[new], length[new] = t, length[t] + length[s]
    return most + 1  # the last symbol of a word is another one than inside


class WordStream:
    """Encodes one word fed in pieces of bytes; returns tokens once they are stable."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""

    def feed(self, data: bytes) -> list[int]:
        m, out = self.merges, []
        self.held += data
        while len(self.held) >= 4 * m.lookahead:
            block = self.held[: 4 * m.lookahead]
            done, stable = 0, []
            for token in m.merge([m.inner[b] for b in block]):
                n = self._length(token)
                if done + n > len(block) - m.lookahead:
                    break
                done += n
                stable.append(token)
            out += stable
            self.held = self.held[done:]
        return out

    def _length(self, token: int) -> int:
        text = self.merges.surface[token].decode()
        return len(text.removesuffix(self.merges.suffix)) if self.merges.suffix else len(text)

    def finish(self) -> list[int]:
        m, data = self.merges, self.held
        self.held = b""
        return m.merge([*(m.inner[b] for b in data[:-1]), m.last[data[-1]]]) if data else []


class _Cache(dict):
    """Little-endian ids of words, encoded as they are first met."""

    def __init__(self, merges: Merges):
        self.merges = merges

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        stream = WordStream(self.merges)
        out = np.array(stream.feed(data) + stream.finish(), "<u4").tobytes()
        if len(data) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


class StreamingEncoder:
    """Encodes a text fed in pieces; `feed` and `finish` return little-endian 32-bit ids."""

    def __init__(self, merges: Merges, cache: _Cache | None = None):
        self.merges = merges
        self.cache = _Cache(merges) if cache is None else cache
        self.specials = regex.compile("|".join(map(regex.escape, merges.specials))) if merges.specials else None
        self.longest = max(map(len, merges.specials), default=1)
        self.raw = ""  # not yet normalized
        self.text = ""  # normalized, in which a word may still be open
        self.open: tuple[WordStream, int] | None = None  # a long word and its kind

    def feed(self, piece: str) -> bytes:
        self.raw += piece
        out = []
        while self.specials and (m := self.specials.search(self.raw)):
            out.append(self._segment(self.raw[: m.start()], True))
            out.append(np.array([self.merges.specials[m.group()]], "<u4").tobytes())
            self.raw = self.raw[m.end() :]
        cut = max(0, len(self.raw) - self.longest)
        while cut > 0 and not self._starts(self.raw[cut]):
            cut -= 1
        out.append(self._segment(self.raw[:cut], False))
        self.raw = self.raw[cut:]
        return b"".join(out)

    def finish(self) -> bytes:
        out = self.feed("") + self._segment(self.raw, True)
        self.raw = ""
        return out

    @staticmethod
    def _starts(c: str) -> bool:
        """Whether normalization never joins this character to the one before."""
        return c < "\x80" or (unicodedata.combining(c) == 0 and c not in _COMPOSING)

    def _segment(self, raw: str, last: bool) -> bytes:
        text = self.text + _lower(unicodedata.normalize("NFC", raw))
        out, at = [], 0
        if self.open:
            stream, kind = self.open
            at = _RUNS[kind].match(text).end()
            out += [np.array(stream.feed(text[:at].encode()), "<u4").tobytes()]
            if at == len(text) and not last:
                self.text = ""
                return out[0]
            out.append(np.array(stream.finish(), "<u4").tobytes())
            self.open = None
        found = _WORD.findall(text, at)
        self.text = ""
        # the last word may go on
        if not last and found and text.endswith(found[-1]):
            word = found.pop()
            if len(word) > LONG_WORD:
                self.open = (WordStream(self.merges), 0 if _LETTER.match(word) else 1)
                out += map(self.cache.__getitem__, found)
                out.append(np.array(self.open[0].feed(word.encode()), "<u4").tobytes())
                return b"".join(out)
            if found and found[-1] == "'" and len(word) == 1 and text.endswith("'" + word):
                word = found.pop() + word  # may become a contraction of two letters
            self.text = word
        out += map(self.cache.__getitem__, found)
        return b"".join(out)


_COMPOSING = _composing()


def _lower(text: str) -> str:
    """Lower case character by character (no final sigma)."""
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


def encode(text: str, merges: Merges, cache: _Cache | None = None) -> Iterator[bytes]:
    """Little-endian ids of a text, piece by piece."""
    encoder = StreamingEncoder(merges, cache)
    for k in range(0, len(text), SLICE):
        yield encoder.feed(text[k : k + SLICE])
    yield encoder.finish()


class StreamingDecoder:
    """Tokens to text piece by piece.

    `surface`: tokens as the vocabulary writes them, joined by a space (what the
    library's decode gives for a file without a decoder).  Otherwise the bytes
    that the tokens stand for, each end of word a space.
    """

    def __init__(self, merges: Merges, surface: bool = True):
        self.first = True
        self.glue = b" " if surface else b""
        self.table = merges.surface if surface else _token_bytes(merges)
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        if not ids:
            return ""
        data = self.glue.join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if not self.first:
            data = self.glue + data
        self.first = False
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def _token_bytes(merges: Merges) -> list[bytes]:
    back = {c: b for b, c in enumerate(byte_symbols())}
    special = set(merges.specials.values())
    out = []
    for i, surface in enumerate(merges.surface):
        text = surface.decode()
        if i in special:
            out.append(surface)
            continue
        ends = bool(merges.suffix) and text.endswith(merges.suffix)
        out.append(bytes(back[c] for c in (text.removesuffix(merges.suffix) if ends else text)) + (b" " if ends else b""))
    return out


_loaded: dict[str, tuple[Merges, _Cache]] = {}


def load(path: str) -> tuple[Merges, _Cache]:
    """Merges and word cache of a tokenizer file, once per Python process."""
    if path not in _loaded:
        merges = Merges(path)
        _loaded[path] = (merges, _Cache(merges))
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The `keep` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (binary, little-endian 32-bit)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, cache = load(path)
        for part in parts:
            for k in range(0, part.num_rows, 1000):
                cut = part.slice(k, 1000)
                counts, ids_hash, text_hash, all_ids = [], [], [], []
                for one in cut.column(len(keep)).to_pylist():
                    n, a, b, decoder, own = 0, hashlib.sha256(), hashlib.sha256(), StreamingDecoder(merges), []
                    for ids in encode(one or "", merges, cache):
                        n += len(ids) // 4
                        a.update(ids)
                        b.update(decoder.feed(ids).encode())
                        if with_ids:
                            own.append(ids)
                    b.update(decoder.finish().encode())
                    counts.append(n)
                    ids_hash.append(a.hexdigest())
                    text_hash.append(b.hexdigest())
                    all_ids.append(b"".join(own))
                arrays = [*(cut.column(i) for i in range(len(keep))), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(all_ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    picked = docs.select(*keep, F.col(text).alias("text_"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(run, f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
