"""Token counts through a whole-token table.

A pre-token is a run of spaces with the characters up to the next space or
line feed, or a line feed with the characters after it. No vocabulary string
holds a space after another character or a line feed at all, so no merge can
cross the border of two pre-tokens, and a text's count is the sum over its
pre-tokens. ``prove`` checks these premises on the model and lists the
vocabulary strings that encode alone as exactly one token; those count 1
without the library, the rest are merged by it once per distinct pre-token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinlink.llm.common import CACHE_LIMIT, load, parts, text_column

SPACE = "▁"
PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")


def open_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def prove(model) -> frozenset[str]:
    """Pre-tokens that are certain to be one token; raises if a premise fails."""
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in ordinary]
    for p in pieces:
        if not re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) or "\n" in p:
            raise ValueError(f"merges can cross pre-tokens: {p!r}")
    if len(model.encode("\n")) != 2:
        raise ValueError("a line feed is not a token of its own")
    starting = [p for p in pieces if p.startswith(SPACE)]
    encoded = model.encode([p[1:].replace(SPACE, " ") for p in starting], num_threads=1)
    return frozenset(p.replace(SPACE, " ") for p, ids in zip(starting, encoded, strict=True) if len(ids) == 1 and model.id_to_piece(ids[0]) == p)


class Counter:
    """Counts the tokens of texts; made once per worker process.

    ``cache`` maps the characters between two spaces to the tokens of the
    pre-tokens they stand for; what a batch misses goes to the library at once.
    """

    made: dict[str, Counter] = {}

    def __init__(self, path: str):
        self.model = open_model(path)
        try:
            self.whole: frozenset[str] | None = prove(self.model)
        except ValueError:  # merges of this model may cross pre-tokens: the library counts whole texts
            self.whole = None
        self.cache: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def learn(self, pre_tokens: set[str]) -> None:
        """Merge those pre-tokens that the whole-token table doesn't hold."""
        rest = []
        for p in pre_tokens:
            if p in self.whole or p == " ":  # the library drops an empty text's space, but not one inside or at the end of a text
                self.parts[p] = 1
            else:
                rest.append(p)
        # The library puts a space in front of each: it is part of a pre-token that starts with one, else a token of its own.
        for p, ids in zip(rest, self.model.encode([p[1:] if p[0] == " " else p for p in rest], num_threads=1), strict=True):
            self.parts[p] = len(ids) - (p[0] == "\n")

    def __call__(self, texts: list[str]) -> list[int]:
        if self.whole is None:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        if len(self.cache) > CACHE_LIMIT:
            self.cache.clear()
            self.parts.clear()
        plain, odd = [], []
        for text in texts:
            text = text.replace(SPACE, " ")
            single = "  " not in text and text[:1] != " " and text[-1:] != " "
            plain.append(text.split(" ") if single and text else None)
            odd.append(PRE_TOKEN.findall(" " + text) if text and not single else [])
        new = set(filterfalse(self.cache.__contains__, chain.from_iterable(filter(None, plain))))
        made = {w: PRE_TOKEN.findall(" " + w) for w in new}
        self.learn({p for ps in (*made.values(), *odd) for p in ps} - self.parts.keys())
        for w, ps in made.items():
            self.cache[w] = sum(map(self.parts.__getitem__, ps))
        count, part = self.cache.__getitem__, self.parts.__getitem__
        return [sum(map(count, words)) if words else sum(map(part, ps)) for words, ps in zip(plain, odd, strict=True)]


def count_tokens(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column_name: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    Null texts count as empty (0 bytes, 0 tokens); repeated rows give repeated
    rows; a null id stays null; other columns are not read; an empty table
    gives no rows. Texts are counted whole, whatever their length. One scan,
    no shuffle.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter.of(model_file)
        for part in parts(batches, text_column_name, 4 << 20):
            texts = text_column(part, text_column_name)
            n = count(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_column, text_column_name).mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
