"""Token counts by the whole-token shortcut.

Once per worker every vocabulary string is encoded alone; those that give exactly one token are the *whole tokens*.
A text is cut before each single space (always a pre-token boundary), pieces are cut into pre-tokens, a pre-token that is
a whole token counts one, and only the rest goes through the tokenizer's merges. Counts of pieces are memoised in a table
of bounded size. Texts holding an added token's string, or white space runs where that cut is not a boundary, are counted
by the library as a whole.

Nulls and empty texts count 0 tokens. Texts are counted whole, whatever their length. Repeated rows and null ids are counted each; an empty
table gives an empty result. Input columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tipoff.llm.common import map_batches, texts_of

#: Pieces whose count is kept for a task's life; the most frequent ones come early.
MEMO = 400_000
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_PLAIN = re.compile(r"[\x00-ɏ]*")


@lru_cache(2)
def _load(path: str):
    """The tokenizer, its whole tokens as text, its added tokens' strings, and the merging of one pre-token by ranks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    own = [chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if chr(b) not in own]
    to_byte = {c: ord(c) for c in own} | {chr(256 + k): b for k, b in enumerate(rest)}
    added = [t.content for t in tok.get_added_tokens_decoder().values() if t.content]
    ranks = {bytes(to_byte[c] for c in piece): i for piece, i in tok.get_vocab(with_added_tokens=False).items() if piece not in added}
    strings = []
    for raw in ranks:
        try:
            strings.append(raw.decode())
        except UnicodeDecodeError:
            continue
    proof = tok.encode_batch(strings, add_special_tokens=False)
    merge = tiktoken.Encoding("ranks", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return tok, {s for s, e in zip(strings, proof, strict=True) if len(e.ids) == 1}, added, merge


class Counter:
    def __init__(self, path: str):
        import regex

        self.tok, self.whole, self.added, self.merge = _load(path)
        self.cut = regex.compile(PRETOKEN).findall
        self.memo: dict[str, int] = {}

    def library(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def piece(self, text: str) -> int:
        """Tokens of one piece: pre-tokens that are whole tokens count one, the rest are merged."""
        if text in self.whole:
            return 1
        if not _PLAIN.fullmatch(text):
            return self.library(text)
        return sum(1 if t in self.whole else len(self.merge(t.encode())) for t in self.cut(text))

    def count(self, text: str) -> int:
        if any(a in text for a in self.added) or _UNSAFE.search(text):
            return self.library(text)
        memo, (head, *tail) = self.memo, text.split(" ")
        n = self.piece(head) if head else 0
        known = list(map(memo.get, tail))
        if None in known:
            room = len(memo) < MEMO
            for k, c in enumerate(known):
                if c is None:
                    known[k] = c = self.piece(" " + tail[k])
                    if room and len(tail[k]) < 64:
                        memo[tail[k]] = c
        return n + sum(known)

    def counts(self, texts: list[str]) -> list[int]:
        return list(map(self.count, texts))


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def make():
        counter = Counter(path)

        def step(batch):
            texts = texts_of(batch.column(1))
            n = counter.counts(texts)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n])], [id_col, "n_bytes", "n_tokens", "over_limit"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), make, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
