"""Token counts of whole texts, without keeping a token.

Arrow steps collect rows until a group holds a fixed number of bytes, cut texts
where the tokenizer provably never joins what stands on both sides, encode every
distinct piece of the group in one batch, and add up lengths. Work and memory
follow bytes, not rows: one very long text is cut like any other.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are encoded together, and bytes of a slice of one long text.
GROUP_BYTES = 4_000_000
SLICE_BYTES = 1_000_000
#: Distinct pieces whose length a task remembers before it starts over.
KEPT_PIECES = 400_000

RESULT = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
_SPACE = re.compile(rb"[\x20\t-\r]")


def _slices(raw: bytes) -> Iterator[bytes]:
    """``raw`` in slices of about SLICE_BYTES, each ending at white space."""
    start = 0
    while len(raw) - start > SLICE_BYTES and (cut := _SPACE.search(raw, start + SLICE_BYTES)):
        yield raw[start : cut.start()]
        start = cut.start()
    yield raw[start:]


def _drops_space(tokenizer) -> bool:
    """Does the tokenizer split on its pattern's matches alone, none of which holds white space?

    Then ASCII white space is a safe boundary: nothing is normalised across it,
    it yields no token, and no token reaches over it.
    """
    spec = json.loads(tokenizer.to_str())
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [spec["pre_tokenizer"] or {}]
    first, rest = steps[0], steps[1:]
    forms = (spec["normalizer"] or {}).get("normalizers") or ([spec["normalizer"]] if spec["normalizer"] else [])
    return (
        first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"]
        and r"[^\s" in first["pattern"].get("Regex", "") and not re.search(r"[ .]|\\[^pnNLs{]|(?<!\^)\\s", first["pattern"]["Regex"])
        and all(x["type"] == "ByteLevel" and not x["use_regex"] and not x["add_prefix_space"] for x in rest)
        and all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in forms)
        and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"])
    )


def _counter(path: str) -> tuple[Callable[[list[str]], list[int]], Callable[[bytes], list[bytes]]]:
    """What encodes a batch to lengths, and what cuts a text into independent pieces."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], lambda raw: [raw]
    if not path.endswith(".json"):
        raise ValueError("a tokenizer file ends in .json or .model")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if _drops_space(tokenizer):
        return lengths, lambda raw: [word for part in _slices(raw) for word in part.split()]
    return lengths, lambda raw: [raw]


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, cut = _counter(path)
        known: dict[bytes, int] = {}

        def flush(group: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            pieces = [cut(raw) for _, raw in group]
            if len(known) > KEPT_PIECES:
                known.clear()
            new = list(set().union(*pieces).difference(known))
            start = 0
            while start < len(new):  # batches of bounded bytes here too
                end, size = start, 0
                while end < len(new) and size < SLICE_BYTES:
                    size += len(new[end])
                    end += 1
                known.update(zip(new[start:end], lengths([x.decode() for x in new[start:end]])))
                start = end
            counts = [sum(map(known.__getitem__, x)) for x in pieces]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_id for doc_id, _ in group], pa.int64()), pa.array([len(raw) for _, raw in group], pa.int64()),
                    pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        group, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                raw = (text.as_py() or "").encode()
                group.append((doc_id.as_py(), raw))
                size += len(raw) + 64
                if size >= GROUP_BYTES:
                    yield flush(group)
                    group, size = [], 0
        if group:
            yield flush(group)

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, as the tokenizer at ``path`` counts.

    ``.json`` files are read by tokenizers, ``.model`` files by sentencepiece;
    no special tokens are added, and their strings inside a text are handled as
    the library does by default. Texts are cut at ASCII white space where the
    file proves that safe, and encoded whole where it does not. A null text
    counts as empty (0 tokens); a null id stays null; repeated rows give
    repeated results; an empty table gives no rows; other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_count(path, limit), RESULT)
