"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as exactly one token is proved once, by running
each through the library. A word's pre-tokens found in that set count one each; only
the rest are merged, once per worker and distinct pre-token, by the library itself.

Defined results: null or empty text has 0 bytes and 0 tokens; words with characters
whose folding or splitting isn't plain, and texts that hold a special token's
opening ``<|``, go to the library whole; very long texts are counted whole, about 2 MB of texts (or one
text) at a time; repeated rows are counted each; an empty table gives no rows. Columns other than the id and the
text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.store import table
from sluice.llm.wordbytes import Words, pieces, text_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
CACHE_ENTRIES = 300_000
#: Words of these characters only split as below: no apostrophes (contractions), no
#: capitals beyond ASCII, nothing that normalisation could change.
_PLAIN = re.compile(r"[!-&(-@\[-~à-öø-ÿ]+")
_PRE = re.compile(r"[a-zà-öø-ÿ]+|[0-9]|[^a-z0-9à-öø-ÿ]+")


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that, alone, are one pre-token and encode as one token."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    texts = {t for i in range(library.get_vocab_size()) if (t := library.decode([i]).removesuffix("</w>").strip()) and t not in special and _PLAIN.fullmatch(t)}
    texts = sorted(t for t in texts if len(_PRE.findall(t)) == 1)
    return frozenset(t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1)


class Counter:
    def __init__(self, path: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.whole = whole
        self.parts: dict[str, int] = {}
        self.words: dict[bytes, int] = {}

    def one(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _merge(self, parts: list[str]) -> None:
        """Count pre-tokens in bulk: white space parts them, and each token names its word."""
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            words = np.array(self.library.encode(" ".join(some), add_special_tokens=False).word_ids, dtype=np.int64)
            got = np.bincount(words, minlength=len(some))
            if len(got) != len(some):  # the library split one: count them one by one
                got = np.array([self.one(p) for p in some], dtype=np.int64)
            self.parts.update(zip(some, got.tolist()))

    def learn(self, words: list[bytes]) -> None:
        whole, known = self.whole, self.parts
        if len(known) > CACHE_ENTRIES:
            known.clear()
        plain: list[tuple[bytes, list[str]]] = []
        fresh: set[str] = set()
        for w in words:
            text = w.decode("utf-8", "replace")
            if not text.isascii() and max(text) <= "\xff":
                text = text.lower()  # Latin-1 letters fold one to one
            if not _PLAIN.fullmatch(text):
                self.words[w] = self.one(text)
                continue
            parts = _PRE.findall(text)
            plain.append((w, parts))
            fresh.update(p for p in parts if p not in whole and p not in known)
        self._merge(sorted(fresh))
        for w, parts in plain:
            self.words[w] = sum(1 if p in whole else known[p] for p in parts)

    def count(self, texts: pa.Array) -> np.ndarray:
        split = Words(texts)
        index, distinct = split.encode()
        if len(self.words) + len(distinct) > CACHE_ENTRIES:
            self.words.clear()
        missing = [w for w in distinct if w not in self.words]
        if missing:
            self.learn(missing)
        size = np.fromiter(map(self.words.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        run = np.zeros(len(index) + 1, dtype=np.int64)
        np.cumsum(size[index], out=run[1:])
        out = run[split.first[1:]] - run[split.first[:-1]]
        odd = pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False)
        for d in np.flatnonzero(odd):
            out[d] = self.one(texts[int(d)].as_py())
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, whole.value)
        for batch in pieces(batches):
            texts = batch.column("text")
            n = counter.count(texts)
            sizes = np.diff(text_bytes(texts)[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
