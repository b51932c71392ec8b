"""Token counts of whole texts under a sentencepiece BPE model, by heap-and-linked-list merging.

A word's count is its characters less its merges (a character outside the vocabulary counts its UTF-8 bytes); no ids are
made. No piece of such a model has the space mark inside or at its end after other characters, so a text may be cut
before every run of space marks, and each distinct word is merged once per worker and looked up from then on. If a
model has a piece that breaks the rule, texts are merged whole.

Null and empty texts have 0 bytes and 0 tokens. Extra columns are ignored; rows, also repeated ones, are kept as they
are, one result each."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.merging import merge
from lotwise.llm.shared import byte_slices, worker_state

SPACE = "▁"
LIMIT = 4096
SLICE_BYTES = 16 << 20  # text that is split at a time in a task
CACHED = 1_500_000  # distinct words a worker remembers; beyond that it starts anew


class WordCounts(dict):
    """Tokens of a word, counted when first asked for. A word is written as it stands between spaces; its space mark is
    put back unless a line break leads it."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = range(sp.get_piece_size())
        plain = [i for i in pieces if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        many = [p for p in self.rank if len(p) > 1]
        self.cut = all(SPACE not in p.lstrip(SPACE) for p in many)
        self.lines = "\n" not in self.rank and not any("\n" in p for p in many)

    def joined(self, pair):
        whole = pair[0] + pair[1]
        rank = self.rank.get(whole)
        return None if rank is None else (rank, whole)

    def tokens(self, word: str) -> int:
        left = merge(list(word), self.joined)
        return sum(1 if s in self.rank else len(s.encode()) for s in left)

    def __missing__(self, word: str) -> int:
        n = self.tokens(word if word.startswith("\n") else SPACE + word)
        self[word] = n
        return n

    def whole_text(self, text: str) -> int:
        """Any text: cut before runs of space marks only."""
        if not text:
            return 0
        line = SPACE + text.replace(" ", SPACE)
        if not self.cut:
            return self.tokens(line)
        return sum(map(self.tokens, re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line)))


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text, as sentencepiece counts them without begin and end tokens."""
    odd = f"  | \n|^ | $|{SPACE}"

    def run(batches):
        known = worker_state("counts:" + model, lambda: WordCounts(model))
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                if len(known) > CACHED:
                    known.clear()
                text = pc.fill_null(batch.column(1), "")
                n_bytes = pc.cast(pc.binary_length(text), pa.int64())
                tokens = np.zeros(len(text), np.int64)
                slow = np.asarray(pc.match_substring_regex(text, odd)) if known.cut and known.lines else np.ones(len(text), bool)
                for i in np.flatnonzero(slow):
                    tokens[i] = known.whole_text(text[i].as_py())
                # a break leads the word after it, as a word of its own kind
                words = pc.split_pattern(pc.replace_substring(text, "\n", " \n"), " ")
                flat = words.values.dictionary_encode() if len(words) else None
                if flat is not None and len(flat):
                    of_word = np.zeros(len(flat.dictionary), np.int64)
                    rows = np.repeat(np.arange(len(text)), np.diff(np.asarray(words.offsets)))
                    codes = np.asarray(flat.indices)
                    used = np.zeros(len(of_word), bool)
                    used[codes[~slow[rows]]] = True
                    at = np.flatnonzero(used)
                    of_word[at] = list(map(known.__getitem__, flat.dictionary.take(pa.array(at)).to_numpy(zero_copy_only=False)))
                    sums = np.bincount(rows, of_word[codes], len(text)).astype(np.int64)
                    full = ~slow & (np.asarray(n_bytes) > 0)
                    tokens[full] = sums[full]
                yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens)], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
