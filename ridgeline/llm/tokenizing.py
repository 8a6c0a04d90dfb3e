"""Word-cached use of the public tokenizer files inside Arrow batches."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

#: Words kept per Python worker, about 170 bytes each; beyond that the older half is forgotten.
CACHE_WORDS = 800_000
#: Characters of a text that are split into words at a time.
BLOCK_CHARS = 1 << 20
#: Words sent to the library in one call.
WORDS_PER_CALL = 256

#: Besides ASCII white space, what str.split() splits at.  Texts that hold any
#: of it go to the library whole, so that its own rule decides.
_OTHER_SPACE = re.compile(r"[^\S \t\n\r\f\v]")

_SPACE = re.compile(r"[ \t\n\r\f\v]")

_ENCODERS: dict[str, "WordEncoder"] = {}


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that runs this."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(name: str) -> str:
    """Hex digest that names the tokenizer's version: its file's bytes."""
    with open(vocabulary_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def drops_white_space(name: str) -> bool:
    """Whether the tokenizer treats any run of white space as one and gives no
    token for it, so that words can be encoded one by one."""
    if not name.endswith(".json"):
        return False
    with open(vocabulary_path(name), encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    collapses = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} for s in steps)
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    removes = any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") for s in splits)
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    return collapses and removes and plain


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes.

    For a tokenizer that drops white space, a text's ids are those of its words
    one after another, so each distinct word goes to the library once per
    worker.  Other tokenizers encode whole texts.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_word = drops_white_space(name)
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        path = vocabulary_path(name)
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            if self.by_word:
                self._letters()
            self._ids = lambda text: self.library.encode(text, add_special_tokens=False).ids
        else:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = self.library.encode

    cache_words = CACHE_WORDS
    #: Words that skip the library's own preparation: none, unless ``_letters`` finds some.
    plain = re.compile(r"(?!)")

    def _letters(self) -> None:
        """Letters that the library's own normalizer and pre-tokenizer map one
        by one.  Words of such letters, and marks after them, skip both."""
        lib, table = self.library, {}
        for code in range(0x41, 0x180):
            own = chr(code)
            if own.isalpha():
                pieces = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(own))
                pair = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(own + "a"))
                if len(pieces) == len(pair) == 1 and pair[0][0] == pieces[0][0] + "a":
                    table[code] = pieces[0][0]
        self.table = table
        letters = re.escape("".join(map(chr, table)))
        self.plain = re.compile(f"([{letters}]+)([.,;:!?#$%&*|)\\]]*)")

    def _stem(self, stem: str) -> bytes:
        mapped = stem.translate(self.table)
        found = self.stems.get(mapped)
        if found is None:
            found = b"".join([t.id.to_bytes(4, "little") for t in self.library.model.tokenize(mapped)])
            self.stems[mapped] = found
        return found

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self._ids(text), dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        match, known = self.plain.fullmatch, self.words
        split = [(w, match(w)) for w in words]
        rest = {w for w, m in split if m is None} | {m[2] for _, m in split if m is not None and m[2]}
        self._learn_by_library([w for w in rest if w not in known])
        for w, m in split:
            if m is not None:
                known[w] = self._stem(m[1]) + known[m[2]] if m[2] else self._stem(m[1])

    def _learn_by_library(self, words: list[str]) -> None:
        import numpy as np

        for at in range(0, len(words), WORDS_PER_CALL):
            part = words[at : at + WORDS_PER_CALL]
            got = self.library.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in part])
            begins = np.fromiter((a for a, _ in got.offsets), np.int64, len(got))
            cuts = np.searchsorted(begins, ends)
            ids = np.asarray(got.ids, dtype="<u4").tobytes()
            begin = 0
            for word, cut in zip(part, cuts.tolist()):
                self.words[word] = ids[4 * begin : 4 * cut]
                begin = cut

    def _know(self, words: Iterable[str]) -> None:
        """Have the ids of all of ``words`` in the cache."""
        if len(self.words) > self.cache_words:
            self.words, self.stems = (dict(islice(d.items(), len(d) // 2, None)) for d in (self.words, self.stems))
        known = self.words
        self._learn([w for w in set(words) if w not in known])

    def _joined(self, words: list[str]) -> bytes:
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, whatever its length: short ones together, a long
        one a block of words at a time."""
        whole = [not self.by_word or _OTHER_SPACE.search(t) is not None for t in texts]
        short = [t.split() if not w and len(t) <= BLOCK_CHARS else [] for t, w in zip(texts, whole)]
        self._know(chain.from_iterable(short))
        joined = [self._joined(ws) for ws in short]
        for k, text in enumerate(texts):
            if whole[k]:
                joined[k] = self._whole(text)
            elif len(text) > BLOCK_CHARS:
                parts = []
                for block in _blocks(text):
                    words = block.split()
                    self._know(words)
                    parts.append(self._joined(words))
                joined[k] = b"".join(parts)
        return joined


def _blocks(text: str) -> Iterator[str]:
    """Parts of a long text, cut at white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, min(len(text), at + BLOCK_CHARS))
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def encoder(name: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """The worker's encoder for a vocabulary file; its cache outlives a task."""
    if name not in _ENCODERS:
        _ENCODERS[name] = WordEncoder(name)
    _ENCODERS[name].cache_words = cache_words
    return _ENCODERS[name]
