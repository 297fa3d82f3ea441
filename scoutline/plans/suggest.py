"""The suggestion job: from a table of components to stored predictions of every row and a stored batch to measure next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from ..operators import cotrain, evaluate, features, reduce
from ..operators.splits import labelled_set
from ..sources import tables
from .loop import LoopSettings, one_round
from .recommend import trim

GRAM_WIDTH = 4096  # above it no matrix of the square of the width is built


@dataclass(frozen=True)
class Stored:
    predictions: str
    suggestions: str


def reduced_view(space: DataFrame, components: list[str], n_bits: int, k: int) -> DataFrame:
    """(row_id, features): fingerprints of the components side by side, projected on their first k singular vectors."""
    encoded = cut_lineage(features.hash_fingerprint(space, components, n_bits).select("row_id", "slots"))
    width = n_bits * len(components)
    model = (reduce.fit_svd_slots(encoded, width, k) if width <= GRAM_WIDTH
             else reduce.fit_svd_wide(encoded, width, k, col="slots", sparse=True))
    return model.transform_slots(encoded).select("row_id", "features")


def suggest(space: DataFrame, components: list[str], root: str, settings: LoopSettings, label: str = "yield", n_bits: int = 512,
            k: int = 32) -> Stored:
    """One round over `space` (row_id, components, label), in which only rows with a known label are labelled.

    Views are the reduced fingerprints and the scaled descriptors of the components. The encoders are co-trained on both, the
    batch is chosen on the encodings by `settings.method`, and a forest on the encodings predicts every row. Both tables are
    overwritten as wholes, so a job that is run again leaves one copy. Without a known label there is nothing to fit: an error.
    """
    s = settings
    space = cut_lineage(space.select("row_id", *components, label))
    known = cut_lineage(labelled_set(space, label).select("row_id"))
    if known.isEmpty():
        raise ValueError(f"no row has a known {label}")
    first = reduced_view(space, components, n_bits, k).join(space.select("row_id", F.col(label).alias("y")), "row_id")
    second = features.minmax(features.descriptor_block(space, components)).select("row_id", "features")
    aligned = cut_lineage(features.align_views(first, second))
    widths = aligned.select(F.size("x0").alias("a"), F.size("x1").alias("b")).first()
    encoders = [cotrain.Encoder.create(w, s.hidden, s.out, s.seed + i) for i, w in enumerate((widths["a"], widths["b"]))]
    done = one_round(aligned, known, encoders, s, s.clusters, s.epochs, evaluate_model=False)
    rows = features.assemble(done.encoded, ["z0", "z1"])
    stored = Stored(f"{root}/predictions", f"{root}/suggestions")
    tables.write_predictions(evaluate.fit_predict_rf(rows, F.col("labelled"), seed=s.seed, trees=s.trees), stored.predictions)
    picks = cut_lineage(done.picks)
    tables.write_suggestions(space, trim(picks, s.step).select(F.col("pick").alias("pos"), "row_id"), stored.suggestions)
    return stored
