"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

import corpus_pipeline

from . import mixing
from .fertility import op4_fertility
from .langid import op3_langid
from .mixing import op9_mixing
from .personal import op10_personal
from .pieces import op5_pieces
from .quality import op7_quality
from .simhash import op1_simhash
from .suffixes import op2_suffixes
from .tokenfile import op6_tokenfile
from .vectors import op8_vectors


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_suffixes, op3_langid, op4_fertility, op5_pieces, op6_tokenfile, op7_quality, op8_vectors, op9_mixing, op10_personal)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op9_mixing": mixing.ORACLE}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
