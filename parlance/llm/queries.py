"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from .divergence import SQL as DIVERGENCE_SQL
from .divergence import op11_divergence
from .fingerprints import op1_fingerprints
from .language import op4_language
from .leaks import op7_decontamination
from .licences import SQL as LICENCES_SQL
from .licences import op2_licences
from .lines import op10_lines
from .merkle import SQL as MERKLE_SQL
from .merkle import op13_merkle
from .near import op6_near_duplicates
from .pieces import op8_sentencepiece
from .quality import op9_quality
from .secrets import op3_secrets
from .sharding import op5_sharding
from .toxicity import op12_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_licences, op3_secrets, op4_language, op5_sharding, op6_near_duplicates, op7_decontamination,
        op8_sentencepiece, op9_quality, op10_lines, op11_divergence, op12_toxicity, op13_merkle,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_licences": LICENCES_SQL, "op11_divergence": DIVERGENCE_SQL, "op13_merkle": MERKLE_SQL}
