"""Encoding of whole texts by their distinct space-separated chunks, a group of batches at a time.

A tokenizer's pre-token pattern never matches across a single space (or line feed) that stands between two characters that
are not white space, so the ids of a text are those of its chunks one after the other. Natural text repeats its words: a group of
texts is split and dictionary-encoded by Arrow, each distinct word is given to the tokenizer once, and the ids of all texts are
gathered by one indexing step. Nothing is remembered from group to group, so memory is bounded by a group. All steps keep whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are encoded together (more where one Arrow batch has more).
GROUP_BYTES = 8 << 20
#: Words given to the tokenizer at a time.
WORDS = 2000
_SINGLE = re.compile(r"(?<=\S)(?=[ \n]\S)")
_TAIL = ".,;:!?*$&%#|()"
#: Latin letters, which every version of Unicode calls letters and which composing (NFC) leaves as they are. U+0130 is left out: its
#: lower case is no letter alone.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_LETTER_SET = "".join(c for c in map(chr, range(0x250)) if re.fullmatch(f"[{_LETTERS}]", c))
_ODD = -1
#: Ids of strings one after the other, and how many each has.
Ids = tuple[np.ndarray, np.ndarray]


def joined(parts: list) -> Ids:
    """Lists of ids as one array and their sizes."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate([np.asarray(p, np.uint32) for p in parts]) if parts else np.empty(0, np.uint32)), sizes


class _Pool:
    """Ids of the strings of one group. An entry is a string's number; entry 0 is the empty string."""

    def __init__(self):
        self.flat, self.used, self.begin, self.size, self.n = np.empty(1 << 16, np.uint32), 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.add(np.empty(0, np.uint32), np.zeros(1, np.int64))

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        first = self.n
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(flat)), np.uint32)])
        if self.n + len(sizes) > len(self.size):
            more = np.zeros(max(len(self.size), len(sizes)), np.int64)
            self.begin, self.size = np.concatenate([self.begin, more]), np.concatenate([self.size, more])
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(sizes)] = sizes
        self.used, self.n = self.used + len(flat), first + len(sizes)
        return first + np.arange(len(sizes))

    def gather(self, entries: np.ndarray) -> Ids:
        sizes = self.size[entries]
        at = np.repeat(self.begin[entries] - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at], sizes

    def chain(self, entries: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New entries, each of which is so many entries one after the other."""
        flat, sizes = self.gather(entries)
        return self.add(flat, np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]))


class ChunkEncoder:
    """encode_batch() gives the ids of texts.

    exact(strings) has the ids of strings that are texts by themselves, words(strings) of strings that are one pre-token each: letters,
    or a space and letters. spaced: words take up the space before them. A text is cut at its spaces; where white space meets a
    cut, it is cut at single spaces only. Else white space is dropped by the tokenizer, and a chunk's ids are the same anywhere.
    fold: words are lower-cased. Texts that hold one of `markers` are given to exact() whole.
    """

    def __init__(self, spaced: bool, exact: Callable[[list[str]], Ids], words: Callable[[list[str]], Ids], fold: bool = False, markers: tuple[str, ...] = ()):
        self.spaced, self.exact, self.words, self.fold, self.markers = spaced, exact, words, fold, markers

    def _texts(self, pool: _Pool, strings: list[str]) -> np.ndarray:
        """Entries of strings that are texts by themselves."""
        new = [s for s in dict.fromkeys(strings) if s]
        entry = {"": 0} | dict(zip(new, pool.add(*self.exact(new)).tolist(), strict=True))
        return np.array([entry[s] for s in strings], np.int64)

    def _split(self, strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Which strings are letters with some punctuation after them, and the letters of those. By all patterns in use these are two pre-tokens."""
        body = pc.utf8_rtrim(strings, characters=_TAIL)
        is_word = pc.match_substring_regex(body, f"^[{_LETTERS}]+$")
        return is_word.to_numpy(zero_copy_only=False), body.filter(is_word)

    def _composed(self, pool: _Pool, strings: pa.Array, body: pa.Array, before: str) -> np.ndarray:
        """Entries of strings that are letters (body) and punctuation, with the same string before each."""
        words = (pc.utf8_lower(body) if self.fold else body).dictionary_encode()
        out = pool.add(*self.words([before + w for w in words.dictionary.to_pylist()]))[words.indices.to_numpy()]
        tails = pc.utf8_ltrim(strings, characters=_LETTER_SET).dictionary_encode()
        tail = self._texts(pool, tails.dictionary.to_pylist())[tails.indices.to_numpy()]
        cut = np.flatnonzero(tail)
        out[cut] = pool.chain(np.stack([out[cut], tail[cut]], 1).ravel(), np.full(len(cut), 2))
        return out

    def _bare(self, pool: _Pool, strings: pa.Array) -> np.ndarray:
        """Entries of strings that are texts by themselves, by their words where they are such."""
        coded = strings.dictionary_encode()
        is_word, body = self._split(coded.dictionary)
        out = np.empty(len(is_word), np.int64)
        out[is_word] = self._composed(pool, coded.dictionary.filter(pa.array(is_word)), body, "")
        out[~is_word] = self._texts(pool, coded.dictionary.filter(pa.array(~is_word)).to_pylist())
        return out[coded.indices.to_numpy()]

    def _after(self, pool: _Pool, chunks: pa.Array) -> np.ndarray:
        """Entries of distinct chunks with a space before each. One that begins or ends with white space, or is empty, is odd."""
        is_word, body = self._split(chunks)
        out = np.full(len(is_word), _ODD)
        out[is_word] = self._composed(pool, chunks.filter(pa.array(is_word)), body, " ")
        rest = np.flatnonzero(~is_word)
        plain, lined, lines = [], [], []
        for i, chunk in zip(rest.tolist(), chunks.take(pa.array(rest)).to_pylist(), strict=True):
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                continue
            parts = chunk.split("\n")
            if len(parts) > 1 and all(x and not x[0].isspace() and not x[-1].isspace() for x in parts):
                lined.append(i)
                lines.append(parts)
            else:
                plain.append((i, " " + chunk))
        out[[i for i, _ in plain]] = self._texts(pool, [c for _, c in plain])
        if lined:
            heads = pa.array([x[0] for x in lines], pa.large_string()).dictionary_encode()
            (feed,) = self._texts(pool, ["\n"]).tolist()
            more = np.array([len(x) - 1 for x in lines])
            first = np.cumsum(2 * more + 1) - (2 * more + 1)
            entries = np.full(int((2 * more + 1).sum()), feed)
            entries[first] = self._after(pool, heads.dictionary)[heads.indices.to_numpy()]
            rest = self._bare(pool, pa.array([y for x in lines for y in x[1:]], pa.large_string()))
            entries[np.repeat(first - 2 * (np.cumsum(more) - more), more) + 2 * np.arange(len(rest)) + 2] = rest
            out[lined] = pool.chain(entries, 2 * more + 1)
        return out

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (uint32) and where each text's begin and end; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        pool = _Pool()
        cut = pc.split_pattern(texts if self.spaced else pc.replace_substring(texts, "\n", " "), " ")
        ends = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        whole = {i for m in self.markers for i in np.flatnonzero(pc.match_substring(texts, m).to_numpy(zero_copy_only=False)).tolist()}
        if self.spaced:
            run = self._after(pool, coded.dictionary)[coded.indices.to_numpy()]
            firsts = coded.dictionary.take(coded.indices.take(pa.array(ends[:-1])))
            ended = np.array([not x or x[-1].isspace() for x in firsts.to_pylist()])
            run[ends[:-1]] = np.where(ended, _ODD, self._bare(pool, firsts))
            odd = set(np.flatnonzero(np.logical_or.reduceat(run == _ODD, ends[:-1])).tolist()) | whole
        else:
            run, odd = self._bare(pool, coded.dictionary)[coded.indices.to_numpy()], whole
        if odd:
            pieces = {i: [texts[i].as_py()] if i in whole else _SINGLE.split(texts[i].as_py()) for i in odd}
            found = self._texts(pool, [x for p in pieces.values() for x in p])
            parts = np.split(run, ends[1:-1])
            for i, p in zip(pieces, np.split(found, np.cumsum([len(p) for p in pieces.values()])[:-1]), strict=True):
                parts[i] = p
            run, ends = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        flat, sizes = pool.gather(run)
        return flat, np.append(0, np.cumsum(sizes))[ends]

    def encode_batches(self, batches, text: str = "text"):
        """Arrow batches, together where they are small, with ids and ends of their texts."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.column(text).nbytes
            if n >= GROUP_BYTES:
                yield self._group(held, text)
                held, n = [], 0
        if held:
            yield self._group(held, text)

    def _group(self, held: list[pa.RecordBatch], text: str):
        (batch,) = pa.Table.from_batches(held).combine_chunks().to_batches() or held[:1]
        return batch, *self.encode_batch(batch.column(text))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        flat, ends = self.encode_batch(pa.array(texts, pa.large_string()))
        raw = flat.astype("<u4", copy=False).tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def byte_letters() -> list[str]:
    """A visible character for each byte, as byte-level vocabularies write it: itself where it is printable in Latin-1, else the
    next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)]


class JsonTokenizer:
    """A byte-level BPE tokenizer from a file of the tokenizers library, as a ChunkEncoder needs it.

    Words are given to the library's model without the pattern, many in one call with a line feed between them; all other
    strings are given to the tokenizer as it is in the file, which reads its special tokens wherever a text has them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.markers = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        letters = byte_letters()
        self.letters, self.mark = {b: letters[b] for b in range(256)}, letters[10]
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Split(self.mark, "isolated")
        (self.mark_id,) = self.model.encode(self.mark, add_special_tokens=False).ids

    def exact(self, strings: list[str]) -> Ids:
        return joined([e.ids for e in self.whole.encode_batch_fast(strings, add_special_tokens=False)])

    def words(self, strings: list[str]) -> Ids:
        groups = ["\n".join(strings[i : i + WORDS]).encode().decode("latin-1").translate(self.letters) for i in range(0, len(strings), WORDS)]
        flats, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for e in self.model.encode_batch_fast(groups, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            marks = ids == self.mark_id
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(marks), [len(ids)]])) - 1)
            flats.append(ids[~marks])
        return np.concatenate(flats), np.concatenate(sizes)
