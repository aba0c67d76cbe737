"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pixelweave.llm.bpe import op2_bpe_round_trip
from pixelweave.llm.decontaminate import OP3_SQL, op3_decontaminate
from pixelweave.llm.embedding_dedup import OP9_SQL, op9_embedding_near_dup
from pixelweave.llm.html_text import op10_html_text
from pixelweave.llm.lexical_search import OP13_SQL, op13_lexical_search
from pixelweave.llm.line_dedup import OP5_SQL, op5_line_dedup
from pixelweave.llm.mixing import op11_mix
from pixelweave.llm.pii import op6_pii
from pixelweave.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from pixelweave.llm.sharding import op4_shards
from pixelweave.llm.simhash import op7_simhash
from pixelweave.llm.token_counts import op1_token_counts
from pixelweave.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_decontaminate": op3_decontaminate,
    "op4_shards": op4_shards,
    "op5_line_dedup": op5_line_dedup,
    "op6_pii": op6_pii,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_embedding_near_dup": op9_embedding_near_dup,
    "op10_html_text": op10_html_text,
    "op11_mix": op11_mix,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lexical_search": op13_lexical_search,
}
ORACLE_SQL = {"op3_decontaminate": OP3_SQL, "op5_line_dedup": OP5_SQL, "op9_embedding_near_dup": OP9_SQL, "op12_prefix_trie": OP12_SQL, "op13_lexical_search": OP13_SQL}
