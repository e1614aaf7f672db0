"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tessel.llm.decontamination import op7_cgk_lsh
from tessel.llm.fill_middle import OP12_SQL, op12_fill_in_middle
from tessel.llm.merkle import OP11_SQL, op11_merkle_manifest
from tessel.llm.mixing import op13_cube_mix
from tessel.llm.ngram_join import OP8_SQL, op8_count_rtree
from tessel.llm.packing import op10_hilbert
from tessel.llm.pii import op5_boosted_pii
from tessel.llm.quality_bayes import op3_empirical_bayes
from tessel.llm.quality_rules import OP6_SQL, op6_line_frequency
from tessel.llm.run_index import OP4_SQL, op4_run_length_index
from tessel.llm.sharding import op9_virtual_slots, slot_map_growth
from tessel.llm.toxicity import op2_attention_gru
from tessel.llm.url_filter import OP1_SQL, op1_temporal_list

QUERIES = {f.__name__: f for f in (op1_temporal_list, op2_attention_gru, op3_empirical_bayes, op4_run_length_index, op5_boosted_pii, op6_line_frequency, op7_cgk_lsh, op8_count_rtree, op9_virtual_slots, op10_hilbert, op11_merkle_manifest, op12_fill_in_middle, op13_cube_mix, slot_map_growth)}
ORACLE_SQL: dict[str, str] = {"op1_temporal_list": OP1_SQL, "op4_run_length_index": OP4_SQL, "op6_line_frequency": OP6_SQL, "op8_count_rtree": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
