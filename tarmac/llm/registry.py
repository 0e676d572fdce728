"""The queries of this folder, for ``__spark_entry__.py``."""

from __future__ import annotations

from tarmac.llm.bpe import op3_bpe
from tarmac.llm.decontaminate import op6_decontaminate
from tarmac.llm.fingerprints import op4_fingerprints
from tarmac.llm.licenses import op5_licenses
from tarmac.llm.oracles import ORACLES
from tarmac.llm.quality import op1_quality
from tarmac.llm.secrets import op8_secrets
from tarmac.llm.sharding import op10_sharding
from tarmac.llm.simhash import op2_simhash
from tarmac.llm.suffixes import op9_suffixes
from tarmac.llm.windows import op7_windows

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_bpe": op3_bpe,
    "op4_fingerprints": op4_fingerprints,
    "op5_licenses": op5_licenses,
    "op6_decontaminate": op6_decontaminate,
    "op7_windows": op7_windows,
    "op8_secrets": op8_secrets,
    "op9_suffixes": op9_suffixes,
    "op10_sharding": op10_sharding,
}
