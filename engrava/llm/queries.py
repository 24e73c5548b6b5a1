"""The subpackage's queries and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from engrava.llm.embeddings import op1_cross_polytope
from engrava.llm.html_text import op11_block_field
from engrava.llm.language import op7_string_kernel
from engrava.llm.merkle import op12_node_store
from engrava.llm.mixing import op5_pareto_mix
from engrava.llm.packing import op10_best_fit
from engrava.llm.quality import op2_byte_network
from engrava.llm.rules import OP9_SQL, op9_host_rules
from engrava.llm.runs import op13_suffix_runs
from engrava.llm.simhash import op4_multi_index
from engrava.llm.token_counts import op3_separator_scan
from engrava.llm.token_output import op8_simple8b
from engrava.llm.url_filter import op6_sql, op6_token_index

QUERIES = {f.__name__: f for f in (op1_cross_polytope, op2_byte_network, op3_separator_scan, op4_multi_index, op5_pareto_mix, op6_token_index, op7_string_kernel, op8_simple8b, op9_host_rules, op10_best_fit, op11_block_field, op12_node_store, op13_suffix_runs)}
#: The other operators hash, learn or tokenise; tests/llm holds these against brute force, round trips and held-out accuracy.
ORACLE_SQL = {"op6_token_index": op6_sql(), "op9_host_rules": OP9_SQL}
