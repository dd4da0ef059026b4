"""Embedding models as injected callables: a policy around a remote one, and one that runs in the worker.

Both take and return a pandas Series, as ``operators.search.embed`` wants them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd

from strandline.params import DEFAULTS

Vectors = list[list[float]]


class Refused(ValueError):
    """The model says that a request is wrong: asking again does not help."""


class Batched:
    """A model (list of texts to list of vectors) asked in batches, with a time limit and retries.

    Texts are cut at ``truncate`` characters.  A ``Refused`` request fails at once; any other failure, a
    wrong number of vectors and a timeout included, is tried again ``retries`` times with doubled waits.
    Equal texts of a batch are asked once.  Nothing here opens a connection: the model does.
    """

    def __init__(
        self, model: Callable[[list[str]], Vectors], batch: int = DEFAULTS.embed_batch, timeout: float = 60.0, retries: int = 2,
        wait: float = 0.5, truncate: int = DEFAULTS.max_embed_chars,
    ):
        self.model, self.batch, self.timeout, self.retries = model, batch, timeout, retries
        self.wait, self.truncate = wait, truncate

    def _once(self, texts: list[str]) -> Vectors:
        pool = ThreadPoolExecutor(1)
        try:
            found = pool.submit(self.model, texts).result(self.timeout)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        if len(found) != len(texts):
            raise RuntimeError(f"{len(found)} vectors for {len(texts)} texts")
        return found

    def _asked(self, texts: list[str]) -> Vectors:
        for attempt in range(self.retries + 1):
            try:
                return self._once(texts)
            except Refused:
                raise
            except Exception:
                if attempt == self.retries:
                    raise
                time.sleep(self.wait * 2**attempt)
        raise AssertionError

    def __call__(self, texts: pd.Series) -> pd.Series:
        cut = texts.fillna("").str.slice(0, self.truncate)
        distinct = list(dict.fromkeys(cut))
        known: dict[str, list[float]] = {}
        for k in range(0, len(distinct), self.batch):
            part = distinct[k : k + self.batch]
            known |= dict(zip(part, self._asked(part), strict=True))
        return pd.Series([known[t] for t in cut], index=texts.index, dtype=object)


_SESSIONS: dict[tuple[str, str], tuple] = {}


class LocalModel:
    """An ONNX encoder run in the worker: loaded once a process, pooled over tokens, normalised.

    ``pooling`` is ``mean`` (over tokens that are no padding) or ``last`` (the last such token).
    """

    def __init__(self, model: str, tokenizer: str, pooling: str = "mean", batch: int = DEFAULTS.embed_batch, most_tokens: int = 512):
        if pooling not in ("mean", "last"):
            raise ValueError(pooling)
        self.model, self.tokenizer, self.pooling, self.batch, self.most_tokens = model, tokenizer, pooling, batch, most_tokens

    def _loaded(self) -> tuple:
        key = self.model, self.tokenizer
        if key not in _SESSIONS:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            _SESSIONS[key] = onnxruntime.InferenceSession(self.model, options, providers=["CPUExecutionProvider"]), Tokenizer.from_file(self.tokenizer)
        return _SESSIONS[key]

    def __call__(self, texts: pd.Series) -> pd.Series:
        session, tokenizer = self._loaded()
        wanted = {i.name for i in session.get_inputs()}
        out: list[list[float]] = []
        values = texts.fillna("").tolist()
        for k in range(0, len(values), self.batch):
            ids = [e.ids[: self.most_tokens] or [0] for e in tokenizer.encode_batch(values[k : k + self.batch])]
            width = max(map(len, ids))
            mask = np.array([[1] * len(row) + [0] * (width - len(row)) for row in ids], np.int64)
            feed = {"input_ids": np.array([row + [0] * (width - len(row)) for row in ids], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            hidden = session.run(None, {n: v for n, v in feed.items() if n in wanted})[0]
            if self.pooling == "mean":
                pooled = (hidden * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1)[:, None]
            else:
                pooled = hidden[np.arange(len(ids)), mask.sum(axis=1) - 1]
            length = np.linalg.norm(pooled, axis=1, keepdims=True)
            out += (pooled / np.where(length > 0, length, 1)).tolist()
        return pd.Series(out, index=texts.index, dtype=object)
