"""From scenes to slots: tiles as dense arrays, a model, and its output as rows.

A model is what factory(path) returns: a function from a dict of float32 arrays (1, size, size, channels),
under the names of INPUTS, to a dict of arrays (1, size, size[, slots]), of which those of OUTPUTS are
taken. It is loaded once per worker.

Tiles overlap, so a pixel is in many of them. Tiles that lie together, TILES_A_SIDE by TILES_A_SIDE, share a
task: their pixels are shuffled once for all of them (at 4 a side, size 256 and stride 64, three times
a pixel in place of sixteen), become one dense block, and each tile is a slice of it. A block is bounded
by these numbers, whatever the scene's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeloom.plans.keyed import by_whole_keys
from plumeloom.sources.emit import loaded_model

TILES_A_SIDE = 4
#: The model's names for its inputs, with ours.
INPUTS = {
    "emit_l1b_radiance": "radiance",
    "emit_l1b_to_sun_zenith": "sun_zenith",
    "emit_l1b_to_sensor_zenith": "sensor_zenith",
    "emit_l1b_crosstrack_id": "crosstrack",
}
#: The model's names for its outputs, with ours.
OUTPUTS = {"concentration": "conc", "binary_masks": "p_plume", "origin_masks": "p_origin"}


def _blocks(at: str, dim: str, size: int, stride: int, side: int) -> Column:
    """The blocks of `side` tiles whose tiles may hold a place."""
    reach, step = size + (side - 1) * stride, side * stride
    tiles = F.expr(f"({dim} - {size}) div {stride}")
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(at) - reach) / step) + 1)
    last = F.least(F.floor(F.col(at) / step), F.floor(tiles / side))
    none = F.array().cast("array<bigint>")
    return F.when((F.col(dim) >= size) & (first <= last), F.sequence(first, last)).otherwise(none)


def dense(y: np.ndarray, x: np.ndarray, column: pa.ChunkedArray, h: int, w: int) -> np.ndarray:
    """A column's values (numbers, or lists of one length) at their places; 0 where nothing is."""
    whole = column.combine_chunks()
    if not pa.types.is_list(whole.type):
        out = np.zeros((h, w, 1), np.float32)
        out[y, x, 0] = np.nan_to_num(whole.cast(pa.float32()).fill_null(0.0).to_numpy(zero_copy_only=False))
        return out
    lengths = whole.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    bands = int(lengths.max(initial=0))
    out = np.zeros((h, w, bands), np.float32)
    full = lengths == bands  # an empty list is a pixel without a spectrum
    values = whole.flatten().cast(pa.float32()).fill_null(0.0).to_numpy(zero_copy_only=False)
    if bands:
        out[y[full], x[full]] = np.nan_to_num(values[np.repeat(full, lengths)].reshape(-1, bands))
    return out


def tiled_inference(pixels: DataFrame, granules: DataFrame, factory, path: str, size: int, stride: int, inputs: dict[str, str] = INPUTS, outputs: dict[str, str] = OUTPUTS, side: int = TILES_A_SIDE) -> DataFrame:
    """Slots of every tile with a valid pixel: granule_id, h_off, w_off, slot_id, y, x and the outputs.

    pixels: granule_id, gy, gx, valid and the inputs' columns (a missing one is 0); granules:
    granule_id, h, w. Tiles that do not fit whole into their scene are left out.
    """
    known = [c for c in inputs.values() if c in pixels.columns]
    px = pixels.select("granule_id", "gy", "gx", "valid", *known).join(F.broadcast(granules.select("granule_id", "h", "w")), "granule_id")  # one row a scene; else the pixels may be broadcast to it
    px = px.withColumn("_by", F.explode(_blocks("gy", "h", size, stride, side))).withColumn("_bx", F.explode(_blocks("gx", "w", size, stride, side)))
    kind = pixels.schema["granule_id"].dataType.simpleString()
    schema = f"granule_id {kind}, h_off long, w_off long, slot_id int, y int, x int, " + ", ".join(f"{c} double" for c in outputs.values())

    def run(table: pa.Table) -> pa.Table:
        model, granule = loaded_model(factory, path), table.column("granule_id").slice(0, 1)
        by, bx, h, w = (table.column(c)[0].as_py() for c in ("_by", "_bx", "h", "w"))
        top, left, reach = by * side * stride, bx * side * stride, size + (side - 1) * stride
        y, x = (table.column(c).to_numpy() - at for c, at in (("gy", top), ("gx", left)))
        block = {name: dense(y, x, table.column(c), reach, reach) if c in known else np.zeros((reach, reach, 1), np.float32) for name, c in inputs.items()}
        valid = dense(y, x, table.column("valid"), reach, reach)[..., 0] > 0
        rows: list[list] = [[] for _ in range(5 + len(outputs))]
        for i in range(side):
            for j in range(side):
                here = slice(i * stride, i * stride + size), slice(j * stride, j * stride + size)
                if top + here[0].stop > h or left + here[1].stop > w or not valid[here].any():
                    continue
                found = model({name: v[here][None] for name, v in block.items()})
                layers = [np.atleast_3d(np.asarray(found[name])[0]).astype(float) for name in outputs]
                slots = max(v.shape[-1] for v in layers)
                layers = [np.broadcast_to(v, (size, size, slots)) for v in layers]
                ys, xs, ks = (v.ravel() for v in np.indices((size, size, slots)))
                place = (np.full(len(ys), top + here[0].start), np.full(len(ys), left + here[1].start), ks, ys, xs)
                for column, v in zip(rows, (*place, *(v.ravel() for v in layers)), strict=True):
                    column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * len(outputs)]
        columns = [pa.array(np.concatenate(v) if v else np.empty(0)).cast(t) for v, t in zip(rows, kinds, strict=True)]
        ids = granule.combine_chunks().take(pa.array(np.zeros(len(columns[0]), np.int32)))
        return pa.table([ids, *columns], names=["granule_id", "h_off", "w_off", "slot_id", "y", "x", *outputs.values()])

    def blocks(table: pa.Table, starts: np.ndarray) -> pa.Table:
        ends = np.append(starts[1:], table.num_rows)
        return pa.concat_tables([run(table.slice(i, j - i)) for i, j in zip(starts, ends, strict=True)])

    return by_whole_keys(px, ["granule_id", "_by", "_bx"], blocks, schema)
