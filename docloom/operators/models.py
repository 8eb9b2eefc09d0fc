"""Python models over columns: loaded once a worker, called in batches, errors as values.

A model is a function of a list of inputs (a tuple each, if there are several input columns) that
returns a list of as many results. ``load`` makes it; it runs on the workers, once for each worker
process, so a model is never pickled with the plan. A batch that fails, is late or gives another
number of results is tried again and then halved, so that only rows which fail on their own carry an
error and no row is lost. ``load`` itself may fail the task: a worker without a model has no rows.
"""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions import text as t

Model = Callable[[list], list]

_KEPT = 4  # models that a worker process holds
_loaded: dict[str, Model] = {}


def _model(key: str, load: Callable[[], Model]) -> Model:
    if key not in _loaded:
        while len(_loaded) >= _KEPT:
            _loaded.pop(next(iter(_loaded)))
        _loaded[key] = load()
    return _loaded[key]


def _within(seconds: float | None, model: Model, inputs: list) -> list:
    """The model's results; a call that takes longer is left to itself."""
    if seconds is None:
        return list(model(inputs))
    box: queue.SimpleQueue = queue.SimpleQueue()

    def call() -> None:
        try:
            box.put((list(model(inputs)), None))
        except Exception as e:
            box.put((None, e))

    threading.Thread(target=call, daemon=True).start()
    try:
        results, error = box.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no result within {seconds} seconds") from None
    if error is not None:
        raise error
    return results


def _results(model: Model, inputs: list, timeout: float | None, retries: int, wait: float) -> list[tuple]:
    """(result, error) of every input."""
    for turn in range(retries + 1):
        if turn:
            time.sleep(wait * 2 ** (turn - 1))
        try:
            results = _within(timeout, model, inputs)
            if len(results) != len(inputs):
                raise ValueError(f"{len(results)} results for {len(inputs)} inputs")
            return [(r, None) for r in results]
        except Exception as e:
            failure = e
    if len(inputs) == 1:
        return [(None, f"{type(failure).__name__}: {failure}")]
    half = len(inputs) // 2
    return [x for part in (inputs[:half], inputs[half:]) for x in _results(model, part, timeout, retries, wait)]


def _arrow(pairs: list[tuple], kind: pa.DataType) -> pa.Array:
    """Results and errors as one array; a result of another type becomes an error."""
    try:
        values = pa.array([v for v, _ in pairs], kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError, OverflowError) as e:
        if len(pairs) == 1:
            return _arrow([(None, f"{type(e).__name__}: {e}")], kind)
        half = len(pairs) // 2
        return pa.concat_arrays([_arrow(pairs[:half], kind), _arrow(pairs[half:], kind)])
    return pa.StructArray.from_arrays([values, pa.array([e for _, e in pairs], pa.string())], names=["result", "error"])


def model_column(
    load: Callable[[], Model], out_type: str | T.DataType = "string", batch: int = 32,
    timeout: float | None = None, retries: int = 1, wait: float = 0.0,
) -> Callable[..., Column]:
    """A function of columns that gives ``struct<result, error>``; exactly one of them is null.

    ``timeout`` (seconds) holds for one call, ``wait`` doubles between retries. A row whose first
    input is null is not sent: its result and error are null. The column counts as not deterministic,
    so Spark neither repeats it nor moves filters before it.
    """
    result = T._parse_datatype_string(out_type) if isinstance(out_type, str) else out_type
    kind = to_arrow_type(result)
    key = uuid.uuid4().hex

    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        model = _model(key, load)
        for arrays in columns:
            lists = [a.to_pylist() for a in ((arrays,) if isinstance(arrays, pa.Array) else arrays)]
            inputs = lists[0] if len(lists) == 1 else list(zip(*lists))
            sent = [i for i, first in enumerate(lists[0]) if first is not None]
            pairs: list[tuple] = [(None, None)] * len(inputs)
            for a in range(0, len(sent), batch):
                some = sent[a : a + batch]
                for i, pair in zip(some, _results(model, [inputs[i] for i in some], timeout, retries, wait)):
                    pairs[i] = pair
            yield _arrow(pairs, kind)

    made = F.arrow_udf(run, T.StructType([T.StructField("result", result), T.StructField("error", T.StringType())]))
    made = made.asNondeterministic()
    return lambda *columns: made(*columns)


def answerer(load: Callable[[], Model], **options) -> Callable[[Column, Column, Column], Column]:
    """An ``answer`` provider: the model turns prompts into answers. Four characters count as a token."""
    column = model_column(load, "string", **options)

    def answer(prompt: Column, query: Column, context: Column) -> Column:
        def shaped(made: Column) -> Column:
            tokens = F.floor((F.length(prompt) + F.coalesce(F.length(made["result"]), F.lit(0))) / 4)
            return F.struct(
                made["result"].alias("answer"),
                tokens.cast("int").alias("tokens_used"),
                made["result"].isNotNull().alias("success"),
                made["error"].alias("error"),
            )

        return t.let(column(prompt), shaped)

    return answer
