"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from .bayes_lsh import op13_bayes_lsh
from .bpe import op1_transducer_bpe
from .fingerprints import op8_imatch
from .jaccard import op10_divide_skip
from .language import op7_subword_language
from .line_dedup import OP4_SQL, op4_site_lines
from .media import op2_png_columns
from .packing import op6_tree_packing
from .prefix_trie import OP12_SQL, op12_centroid_trie
from .quality import op9_kneser_ney
from .sharding import op3_histogram_sort
from .suffix_dedup import op5_induced_sorting
from .vector_codes import OP11_SQL, op11_laesa_codes

QUERIES = {f.__name__: f for f in (op1_transducer_bpe, op2_png_columns, op3_histogram_sort, op4_site_lines, op5_induced_sorting, op6_tree_packing, op7_subword_language, op8_imatch, op9_kneser_ney, op10_divide_skip, op11_laesa_codes, op12_centroid_trie, op13_bayes_lsh)}
ORACLE_SQL = {"op4_site_lines": OP4_SQL, "op11_laesa_codes": OP11_SQL, "op12_centroid_trie": OP12_SQL}
