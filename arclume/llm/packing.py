"""Texts in containers of a fixed number of tokens: vector best-fit under every constraint."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclume.session import materialize, spread

#: Items that one task packs at once, and containers it keeps open for the next ones.
BLOCK, OPEN = 20_000, 2_000
#: Attention cost of a container, as a share of the square of its capacity.
COST_SHARE = 0.75
#: Containers number from task << TASK_BITS.
TASK_BITS = 36


def default_tokenizer() -> str:
    """Place of the public byte-level BPE for many languages."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(path: str):  # noqa: ANN201
    """The tokenizer in the ranks file ``path``; read once per process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Packer:
    """Open containers with residual tokens, items and attention cost (tokens squared, summed over a container's items).

    An item goes to the container that fits it on every count and scores best: ``norm`` takes the least weighted
    squared norm of the residuals that would be left, ``dot`` the largest weighted dot product of item and residuals. Both are
    taken in shares of the capacities. Ties go to the oldest container; an item that fits none opens one.
    """

    def __init__(self, capacity: int, max_items: int, max_cost: float, score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> None:
        if score not in ("norm", "dot"):
            raise ValueError("score is norm or dot")
        self.full = np.array([capacity, max_items, max_cost], dtype=np.float64)
        self.weights, self.dot = np.array(weights), score == "dot"
        self.left = np.empty((64, 3))
        self.ids = np.empty(64, dtype=np.int64)
        self.n = 0
        self.made = 0

    def put(self, tokens: int, items: int = 1, cost: float | None = None) -> int:
        need = np.array([tokens, items, tokens * tokens if cost is None else cost]) / self.full
        left = self.left[: self.n]
        fits = np.flatnonzero((left >= need - 1e-12).all(axis=1))
        if fits.size:
            rest = left[fits]
            score = -(rest * (need * self.weights)).sum(axis=1) if self.dot else (((rest - need) ** 2) * self.weights).sum(axis=1)
            at = fits[np.argmin(score)]
        else:
            if self.n == len(self.ids):
                self.left = np.concatenate([self.left, np.empty_like(self.left)])
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            at, self.n = self.n, self.n + 1
            self.left[at], self.ids[at] = 1.0, self.made
            self.made += 1
        self.left[at] -= need
        return int(self.ids[at])

    def close(self, keep: int, least: float) -> None:
        """Close the containers without room for ``least`` tokens, and the fullest beyond ``keep``."""
        left = self.left[: self.n]
        stay = np.flatnonzero((left[:, 0] * self.full[0] >= max(1, least)) & (left[:, 1] > 0))
        if len(stay) > keep:
            stay = np.sort(stay[np.argsort(-left[stay, 0], kind="stable")[:keep]])
        self.left[: len(stay)], self.ids[: len(stay)] = left[stay], self.ids[stay]
        self.n = len(stay)


def pack_documents(
    documents: DataFrame, capacity: int = 2048, max_items: int = 256, max_cost: float | None = None, tokenizer: str | None = None, score: str = "norm", doc_id: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """Every document's place: (doc_id, tokens, piece, pieces, piece_tokens, container).

    A text stays whole unless it alone has more than ``capacity`` tokens: then its first pieces fill a container each and
    the last piece is packed like a text. Per container at most ``max_items`` pieces and an attention cost (tokens squared, summed over its pieces) of
    ``max_cost``, by default COST_SHARE of capacity squared; a piece that alone costs more has a container of its own. Null and empty texts have no tokens and no container. Rows are packed as they
    come, repeated ids too.

    A task reads, measures and packs its own part of the texts in blocks of ``block``, largest first: no text is shuffled and
    only sizes are held. What stays under half full at a task's end (a container or so) is packed once more with those of
    up to 1,024 other tasks.
    """
    max_cost = float(max_cost or COST_SHARE * capacity * capacity)
    path = tokenizer or default_tokenizer()
    spark = documents.sparkSession
    kept = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")))
    schema = kept.select("doc_id").schema.add("tokens", "integer").add("piece", "integer").add("pieces", "integer").add("piece_tokens", "integer").add("container", "long").add("_half", "boolean")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << TASK_BITS
        enc = encoder(path)
        packer = Packer(capacity, max_items, max_cost, score)
        alone = 1 << (TASK_BITS - 1)
        held: list[pd.DataFrame] = []
        open_rows = pd.DataFrame()

        def settle(last: bool) -> pd.DataFrame:
            """Pack what is held; rows of containers that stay open wait."""
            nonlocal open_rows, alone
            rows = pd.concat(held, ignore_index=True)
            held.clear()
            size = rows["tokens"].to_numpy()
            pieces = np.maximum(1, -(-size // capacity))
            many = rows.loc[rows.index.repeat(pieces)]
            many["pieces"] = np.repeat(pieces, pieces)
            many["piece"] = np.arange(len(many)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            many["piece_tokens"] = np.where(many["piece"] + 1 < many["pieces"], capacity, many["tokens"] - (many["pieces"] - 1) * capacity)
            at = np.full(len(many), -1, dtype=np.int64)
            sizes = many["piece_tokens"].to_numpy()
            for i in np.argsort(-sizes, kind="stable"):
                t = int(sizes[i])
                if t >= capacity or t * t > max_cost:
                    at[i] = alone
                    alone += 1
                elif t > 0:
                    at[i] = packer.put(t)
            many["container"] = at
            every = pd.concat([open_rows, many], ignore_index=True) if len(open_rows) else many
            if last:
                half = set(packer.ids[: packer.n][packer.left[: packer.n, 0] > 0.5].tolist())
                open_rows = pd.DataFrame()
            else:
                packer.close(OPEN, 8)
                still = every["container"].isin(packer.ids[: packer.n])
                open_rows, every, half = every[still], every[~still], set()
            every = every.assign(_half=every["container"].isin(half), container=pd.array(np.where(every["container"] < 0, 0, every["container"] + base), dtype="Int64"))
            every.loc[every["piece_tokens"] == 0, "container"] = pd.NA
            return every[["doc_id", "tokens", "piece", "pieces", "piece_tokens", "container", "_half"]]

        waiting = 0
        for b in batches:
            texts = b["_text"]
            there = texts.map(lambda t: isinstance(t, str) and len(t) > 0)
            size = np.zeros(len(b), dtype=np.int64)
            if there.any():
                size[there.to_numpy()] = [len(x) for x in enc.encode_ordinary_batch(texts[there].tolist(), num_threads=1)]
            held.append(pd.DataFrame({"doc_id": b["doc_id"], "tokens": size}))
            waiting += len(b)
            if waiting >= block:
                waiting = 0
                yield settle(False)
        if held or len(open_rows):
            if not held:
                held.append(open_rows.iloc[:0][["doc_id", "tokens"]])
            yield settle(True)

    first = materialize(kept.mapInPandas(pack, schema), "packed")
    halves = first.filter("_half").groupBy("container").agg(F.sum("piece_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum(F.col("piece_tokens").cast("double") * F.col("piece_tokens")).alias("c"))

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(capacity, max_items, max_cost, score)
        pdf = pdf.sort_values(["t", "container"], ascending=[False, True])
        put = [packer.put(int(t), int(n), float(c)) for t, n, c in zip(pdf["t"], pdf["n"], pdf["c"])]
        names: dict[int, int] = {}
        return pd.DataFrame({"container": pdf["container"], "_to": [names.setdefault(p, c) for p, c in zip(put, pdf["container"])]})

    # at most a few containers of each task, 1,024 tasks together
    moved = halves.withColumn("_g", F.shiftright("container", TASK_BITS + 10)).groupBy("_g").applyInPandas(again, "container long, _to long")
    done = first.filter(~F.col("_half")).drop("_half")
    rest = first.filter("_half").join(moved, "container").withColumn("container", F.col("_to"))
    return done.unionByName(rest.select(*done.columns))


def container_loads(packed: DataFrame) -> DataFrame:
    """(container, tokens, items, cost, largest) of every container."""
    size = F.col("piece_tokens").cast("long")
    return packed.filter(F.col("container").isNotNull()).groupBy("container").agg(F.sum(size).alias("tokens"), F.count(F.lit(1)).alias("items"), F.sum(size * size).alias("cost"), F.max(size).alias("largest"))


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row on the containers: (containers, tokens, fill)."""
    per = packed.filter(F.col("container").isNotNull()).groupBy("container").agg(F.sum("piece_tokens").alias("t"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens")).withColumn("fill", F.col("tokens") / (F.col("containers") * capacity))
