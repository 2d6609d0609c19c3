"""Queries and SQL of this subpackage for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline

from . import decontam, embed, license, minhash, sharding, warc
from .bpe import op9_bpe
from .decontam import op6_decontamination
from .embed import op10_embedding_dedup
from .langid import op5_language_id
from .license import op3_license_scan
from .lm import op4_lm_scoring
from .minhash import op7_minhash
from .quality import op1_quality
from .sharding import op2_sharding
from .warc import op8_warc

_ALL = (op1_quality, op2_sharding, op3_license_scan, op4_lm_scoring, op5_language_id, op6_decontamination, op7_minhash, op8_warc, op9_bpe, op10_embedding_dedup)
QUERIES = {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op2_sharding": sharding.oracle(), "op3_license_scan": license.oracle(), "op6_decontamination": decontam.ORACLE, "op7_minhash": minhash.ORACLE, "op8_warc": warc.ORACLE, "op10_embedding_dedup": embed.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
