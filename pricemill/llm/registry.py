"""The corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .byte_pairs import op11_byte_pairs
from .decontaminate import OP6_SQL, op6_benchmark_decontamination
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .filter_audit import OP12_SQL, op12_filter_audit
from .language import op1_language_id
from .lexical_search import OP13_SQL, op13_ranked_search
from .licences import OP2_SQL, op2_license_scan
from .line_dedup import OP9_SQL, op9_line_dedup
from .near_dedup import op5_minhash_near_dedup
from .packing import op7_best_fit_packing
from .private import op10_private_pseudonyms
from .token_store import op3_token_store
from .warc import op4_warc_derivatives

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_license_scan, op3_token_store, op4_warc_derivatives, op5_minhash_near_dedup, op6_benchmark_decontamination,
        op7_best_fit_packing, op8_exact_dedup, op9_line_dedup, op10_private_pseudonyms, op11_byte_pairs, op12_filter_audit, op13_ranked_search,
    )
}
SQL = {"op2_license_scan": OP2_SQL, "op6_benchmark_decontamination": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op9_line_dedup": OP9_SQL, "op12_filter_audit": OP12_SQL, "op13_ranked_search": OP13_SQL}
