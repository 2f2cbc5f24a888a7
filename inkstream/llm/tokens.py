"""Token counts with a whole-token shortcut, and token ids, for a byte-level BPE vocabulary.

The vocabulary file belongs to the ``tokenizers`` library; its ranks are merged here by ``tiktoken``'s
BPE, which tests hold equal to ``tokenizers`` on every code point class. Texts that its splitter
refuses (extreme runs of blanks) are encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_column, utf8

#: Fixed value: the split pattern of this family of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that newer Unicode versions made letters or numbers, and the planes most of them lie in.
#: Texts with one of them are split by the encoder itself; a sweep over all others holds the splitters equal.
_NEWER = re.compile("[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7e2\ua7f1\uab6c\uab6d\U00010000-\U0001efff\U0002b000-\U0010ffff]")
#: Pieces kept with their counts in one worker, and the longest piece that is kept.
CACHE_PIECES, CACHE_LENGTH = 400_000, 48


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that vocabulary files of this family have for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Counts and ids of one vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = _byte_alphabet()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.path, self.special = path, special
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.core = self.encoding._core_bpe
        self.split = regex.compile(PATTERN).findall
        self.at_special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.whole = self.whole_tokens(ranks)
        self.kept: dict[str, int] = {}

    def whole_tokens(self, ranks: dict[bytes, int]) -> dict[str, int]:
        """Vocabulary strings proved to be one pre-token and to encode alone as exactly their own token."""
        out = {}
        for token, i in ranks.items():
            try:
                s = token.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if not _NEWER.search(s) and self.split(s) == [s] and self.core.encode_single_piece(token) == [i]:
                out[s] = 1
        return out

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    def ids(self, text: str) -> np.ndarray:
        """The ids that the library gives without added special tokens."""
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # the splitter's limits end in a panic, which is no Exception
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def count(self, text: str) -> int:
        """len(ids(text)): pre-tokens that are whole tokens count one, only the rest are merged."""
        if _NEWER.search(text):
            return len(self.ids(text))
        n, parts = 0, [text]
        if self.at_special and self.at_special.search(text):
            parts = self.at_special.split(text)
            n = len(parts) - 1
        for part in parts:
            pieces = self.split(part)
            n += len(pieces)
            whole, kept = self.whole, self.kept
            for piece in [p for p in pieces if p not in whole]:
                c = kept.get(piece)
                if c is None:
                    c = len(self.core.encode_single_piece(piece.encode())) - 1
                    if len(piece) <= CACHE_LENGTH:
                        if len(kept) >= CACHE_PIECES:
                            kept.clear()
                        kept[piece] = c
                n += c
        return n


@functools.lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    """One vocabulary per Python worker."""
    return Bpe(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; null text counts as empty.

    No shuffle: one Arrow pass. Repeated rows give repeated results; other columns are not read. The
    cache of merged pieces is bounded per worker and only saves time.
    """

    def run(batches):
        model = bpe(path)
        for batch in batches:
            texts = batch.column(1)
            _, offsets = utf8(texts)
            n = np.fromiter((model.count(x) for x in texts.to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id].dataType.simpleString()
    return map_arrow(docs.select(F.col(id).alias("doc_id"), text_column(text).alias("text")), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
