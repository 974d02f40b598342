"""The registered queries of this package and their DuckDB counterparts."""

from __future__ import annotations

from .bpe import op8_bpe_codec
from .chat import op2_chat_formatting
from .decontamination import ORACLE as DECONTAMINATION_SQL
from .decontamination import op4_decontamination
from .html import op3_html_extraction
from .licenses import op1_license_scan
from .near_duplicates import ORACLE as NEAR_DUPLICATES_SQL
from .near_duplicates import op5_near_duplicates
from .nearest import ORACLE as NEAREST_SQL
from .nearest import op9_nearest
from .pii import op6_pii
from .sharding import ORACLE as SHARDING_SQL
from .sharding import op10_sharding
from .toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_chat_formatting, op3_html_extraction, op4_decontamination, op5_near_duplicates, op6_pii, op7_toxicity, op8_bpe_codec, op9_nearest, op10_sharding)}
ORACLES = {"op9_nearest": NEAREST_SQL, "op10_sharding": SHARDING_SQL, "op4_decontamination": DECONTAMINATION_SQL, "op5_near_duplicates": NEAR_DUPLICATES_SQL}
