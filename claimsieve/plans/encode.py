"""Feature vectors and labels for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from claimsieve.operators.encoding import Encoder, encode, fit_encoder, to_xy
from claimsieve.staging import Workspace


def encode_claims(labelled: DataFrame, workspace: Workspace, include_flags: bool = True, keep: tuple[str, ...] = ()) -> tuple[DataFrame, Encoder]:
    """(``scaled_features``, ``label``), behind the columns to ``keep``, and the fitted encoder. ``labelled`` is a stored table.

    The label derives from the flags, so with them among the features both classifiers are
    close to perfect; ``include_flags=False`` leaves them out.
    """
    encoder = fit_encoder(labelled, workspace, flags=None if include_flags else ())
    return to_xy(encode(labelled, encoder), *keep), encoder
