"""Model inference as an operator: any model over any table, in Arrow batches.

No weights belong to the library. A model is a function that loads it, called once per task, and gives a function from a
batch (a pandas frame of the input columns) to a frame of the output columns, one row per input row or several.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[pd.DataFrame], pd.DataFrame]

# The outputs of the models that a scan or a verification goes through.
OUTPUTS = {
    "page_detect": "polygon array<array<double>>, crop binary, score double",
    "deskew": "angle double, orientation int, image binary",
    "text_read": "block_id int, text string, confidence double, bbox array<array<int>>",
    "token_tags": "token string, label string, confidence double",
    "pill_detect": "detection_idx int, bbox array<int>, score double, label int",
    "image_embed": "embedding array<float>, color string, shape string",
    "text_classify": "label string, confidence double",
}


def apply(df: DataFrame, load: Callable[[], Model], inputs: Sequence[str], output: str, keep: Sequence[str] = (), batch: int = 64) -> DataFrame:
    """The model's rows for every row of ``df``, with the ``keep`` columns of the row they come from.

    ``output``: a name of ``OUTPUTS`` or a schema. The model's frame has the index of the batch it was given, repeated
    where a row gives several. Input rows are passed in batches of ``batch`` at most; an empty table loads no model.
    """
    produced = OUTPUTS.get(output, output)
    kept = [f for f in df.schema.fields if f.name in keep]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], produced])
    names = [f.name for f in kept]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch].reset_index(drop=True)
                model = model or load()
                out = model(part[list(inputs)])
                yield pd.concat([part[names].loc[out.index].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    return df.select(*dict.fromkeys([*names, *inputs])).mapInPandas(run, schema)
