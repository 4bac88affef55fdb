"""Token counts by the whole-token shortcut.

Most pre-tokens of a text are themselves entries of the vocabulary. Which entries
encode alone as exactly one token is proven once per vocabulary; a pre-token among
them counts one without any merging. Only the others are merged, and each distinct
one only once while a worker remembers it.
"""

from __future__ import annotations

import functools
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftgraph.llm import _common as C

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Pre-tokens longer than this are counted afresh each time, so that the memory of a worker stays bounded.
LONGEST_KEPT = 200


@functools.lru_cache(2)
def proven(path: str):
    """(the library's tokenizer, the strings that encode alone as one token, its special strings)."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each core has a worker of its own
    library = Tokenizer.from_file(path)
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    vocabulary = library.get_vocab(with_added_tokens=False)
    texts = [t for t in (library.decode([i], skip_special_tokens=False) for i in vocabulary.values()) if t and t not in special]
    encoded = library.encode_batch_fast(texts, add_special_tokens=False)
    return library, frozenset(t for t, e in zip(texts, encoded) if len(e.ids) == 1), special


class TokenCounter:
    """Counts the tokens of texts as the library does; a worker keeps one from task to task."""

    def __init__(self, path: str):
        import regex

        self.library, self.whole, special = proven(path)
        self.words = C.Splitter(self.kind)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = dict.fromkeys(self.whole, 1)

    def kind(self, c: str) -> str:
        """The class that the library gives a character, by what it does not part it from."""
        pieces = self.library.pre_tokenizer.pre_tokenize_str
        return next((x for x in "a1!" if len(pieces(x + c)) == 1), "\n")

    def merged(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def plain(self, text: str) -> int:
        words = self.words(text)
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        found = dict(zip(fresh, self.merged(fresh)))
        long = {w: found[w] for w in fresh if len(w) > LONGEST_KEPT}
        self.known.update(found)
        total = sum(map(self.known.__getitem__, words))
        for w in long:
            del self.known[w]
        if len(self.known) > C.WORDS_KEPT:
            self.known = dict.fromkeys(self.whole, 1)
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(self.plain(p) for p in pieces if p)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), a row for each row of docs.

    docs: doc_id, text; other columns are ignored. A null text counts as an empty one
    (0 bytes, 0 tokens); a null doc_id stays null; repeated rows give repeated results;
    an empty table gives an empty one. path: a tokenizer file of the tokenizers library.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        counter = C.held(("counts", path), lambda: TokenCounter(path))
        for batch in batches:
            ids, texts = C.rows_of(batch, "doc_id", "text")
            texts = [t or "" for t in texts]
            tokens = [counter.count(t) for t in texts]
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return C.pick(docs, "doc_id", "text").mapInArrow(run, T.StructType.fromDDL(SCHEMA))
