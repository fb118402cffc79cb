"""Pre-tokens and token ids of texts, word by word.

For a tokeniser whose pre-tokeniser drops white space and whose normaliser turns
white space into white space (word_bpe_49k.json is one), no token crosses an ASCII
white-space character. So a text's ids are its words' ids in order, and a word met
before needs no second tokenisation. Texts are split and their words numbered by
Arrow; Python sees each different word of a slice of texts once. A word's pre-tokens
are what the tokeniser itself makes of it; for words of Latin letters between marks,
where that is known beforehand, they are cut out without asking it.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.common import held

#: Letters in lower case of ASCII, and all from U+00C0 to U+00FF. A word of them is one pre-token, and its normal form is itself but for case.
ASCII, LATIN = "^[a-z]+$", "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Marks that are taken off a word's end, where they are one pre-token of their own.
AFTER = string.punctuation
#: And off its start. An apostrophe may go with letters behind it, and a bar may open a special token.
BEFORE = "".join(sorted(set(AFTER) - set("'|")))
#: Words of a text that are looked up at once.
AT_ONCE = 1 << 19


@dataclass
class Terms:
    """What stands in some texts, one after the other: numbers of the different terms; text k has those from bounds[k] to bounds[k + 1]."""

    different: list[bytes]
    which: np.ndarray
    bounds: np.ndarray


TermsOf = Callable[[pa.Array], Terms]


def spaced(texts: pa.Array, fold: bool = False, end: bytes | None = None) -> Terms:
    """The words of texts (binary) between ASCII white space, A-Z folded if wanted, and the end after each text if there is one."""
    text = texts.cast(pa.string(), safe=False).fill_null("")
    split = pc.ascii_split_whitespace(pc.ascii_lower(text) if fold else text)
    coded = split.flatten().dictionary_encode()
    different = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    which = coded.indices.to_numpy()
    bounds = np.concatenate([[0], np.cumsum(np.asarray(split.value_lengths(), dtype=np.int64))])
    if b"" in different:  # before, after or instead of words
        there = which != different.index(b"")
        bounds, which = np.concatenate([[0], np.cumsum(there)])[bounds], which[there]
    if end is not None:
        which, bounds = np.insert(which, bounds[1:], len(different)), bounds + np.arange(len(bounds))
        different.append(end)
    return Terms(different, which, bounds)


def expanded(which: np.ndarray, size: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands in the pool for each of `which`, and how much it is; number k has size[k] places there, in order."""
    n = size[which]
    stop = np.cumsum(n, dtype=np.int64)
    place = np.repeat((np.cumsum(size, dtype=np.int64) - size)[which] - (stop - n), n)
    place += np.arange(len(place))
    return pool[place], n


class PreTokens:
    """Pre-tokens of words under a tokeniser file, as its model takes them; a special token has a space before it."""

    def __init__(self, path: str, most: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normal, self.pre = self.tokenizer.model, self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        #: Bytes as the characters that stand for them in the model's vocabulary.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.known: dict[bytes, tuple[str, ...]] = {}
        self.most = most

    def asked(self, word: bytes) -> tuple[str, ...]:
        """As the tokeniser's own parts say."""
        text = word.decode("utf-8", "replace")
        out: list[str] = []
        for k, x in enumerate(self.special.split(text) if self.special else [text]):
            out += [" " + x] if k % 2 else [p for p, _ in self.pre(self.normal(x))] if x else []
        return tuple(out)

    def of(self, words: list[bytes]) -> list[tuple[str, ...]]:
        """Pre-tokens of each of these different words."""
        text = pa.array(words, pa.binary()).cast(pa.string(), safe=False)
        tail = pc.ascii_ltrim(text, BEFORE)
        core = pc.ascii_lower(pc.ascii_rtrim(tail, AFTER))
        plain, latin = (np.asarray(pc.match_substring_regex(core, p)).tolist() for p in (ASCII, LATIN))
        start = (np.asarray(pc.binary_length(text)) - np.asarray(pc.binary_length(tail))).tolist()
        size = np.asarray(pc.binary_length(core)).tolist()
        cores = core.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        out, known = [], self.known
        if len(known) > self.most:
            known.clear()
        for w, c, a, n, p, q in zip(words, cores, start, size, plain, latin, strict=True):
            if not q:
                if w not in known:
                    known[w] = self.asked(w)
                out.append(known[w])
                continue
            mid = c.decode() if p else c.decode().lower().encode().decode("latin-1").translate(self.shown)
            out.append((mid,) if n == len(w) else tuple(x for x in (w[:a].decode(), mid, w[a + n :].decode()) if x))
        return out

    def ids(self, piece: str) -> list[int]:
        return [self.tokenizer.token_to_id(piece[1:])] if piece[0] == " " else [t.id for t in self.model.tokenize(piece)]

    def terms(self, texts: pa.Array) -> Terms:
        """The pre-tokens of texts, as bytes."""
        words = spaced(texts)
        each = self.of(words.different)
        codes: dict[str, int] = {}
        pool = np.fromiter((codes.setdefault(x, len(codes)) for own in each for x in own), dtype=np.int32)
        size = np.fromiter(map(len, each), dtype=np.int32, count=len(each))
        which, n = expanded(words.which, size, pool)
        return Terms([x.encode() for x in codes], which, np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[words.bounds])


class WordIds:
    """Ids of white-space words under a tokeniser file, kept for the words seen last; bounded."""

    def __init__(self, path: str, most: int = 150_000):
        self.pre = PreTokens(path, most=20_000)  # a word whose ids are kept isn't asked for again
        self.tokenizer = self.pre.tokenizer
        #: Words of late, and those of before; a word that comes again is taken over.
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.most = most

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of these different words, as bytes."""
        if len(self.known) > self.most:
            self.known, self.before = {}, self.known
        found = list(map(self.known.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        old = list(map(self.before.get, [words[k] for k in missing]))
        fresh = []
        for k, ids in zip(missing, old, strict=True):
            if ids is None:
                fresh.append(k)
            else:
                found[k] = self.known[words[k]] = ids
        if fresh:
            for k, ids in zip(fresh, self.made([words[k] for k in fresh]), strict=True):
                found[k] = self.known[words[k]] = ids
        return found

    def made(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that aren't known."""
        own: dict[str, bytes] = {}
        out = []
        for pieces in self.pre.of(words):
            for x in pieces:
                if x not in own:
                    own[x] = array("I", self.pre.ids(x)).tobytes()
            out.append(own[pieces[0]] if len(pieces) == 1 else b"".join([own[x] for x in pieces]))
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these texts (binary), one after the other, and how many each has."""
        split = pc.ascii_split_whitespace(texts.cast(pa.string(), safe=False).fill_null(""))
        words, bounds = split.flatten(), np.concatenate([[0], np.cumsum(np.asarray(split.value_lengths(), dtype=np.int64))])
        ids, counts = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int32)]
        for at in range(0, len(words), AT_ONCE):
            coded = words.slice(at, AT_ONCE).dictionary_encode()
            own = self.of(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
            found, n = expanded(coded.indices.to_numpy(), np.fromiter(map(len, own), dtype=np.int32, count=len(own)) >> 2, np.frombuffer(b"".join(own), dtype="<u4"))
            ids.append(found)
            counts.append(n)
        so_far = np.concatenate([[0], np.cumsum(np.concatenate(counts), dtype=np.int64)])
        return np.concatenate(ids), np.diff(so_far[bounds])


def word_ids(path: str) -> WordIds:
    """One for each worker process, as workers run many tasks."""
    return held("pack", "ids", lambda: WordIds(path), path)
