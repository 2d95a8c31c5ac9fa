"""The queries of this subpackage and the SQL that some must agree with."""

from __future__ import annotations

from loamgrid.llm.bytebpe import op11_byte_bpe
from loamgrid.llm.decontam import OP5_SQL, op5_decontaminate
from loamgrid.llm.htmltext import op10_html_text
from loamgrid.llm.langid import op1_language_id
from loamgrid.llm.licenses import OP2_SQL, op2_license_scan
from loamgrid.llm.lines import op8_line_dedup
from loamgrid.llm.merkle import OP13_SQL, op13_merkle_manifest
from loamgrid.llm.mixing import OP9_SQL, op9_mix_sources
from loamgrid.llm.neardup import op6_near_duplicates
from loamgrid.llm.negatives import OP12_SQL, op12_hard_negatives
from loamgrid.llm.quality import op4_quality_rules
from loamgrid.llm.toxicity import op3_toxicity
from loamgrid.llm.warc import OP7_SQL, op7_warc_revisits

QUERIES = {f.__name__: f for f in (op1_language_id, op2_license_scan, op3_toxicity, op4_quality_rules, op5_decontaminate, op6_near_duplicates, op7_warc_revisits, op8_line_dedup, op9_mix_sources, op10_html_text, op11_byte_bpe, op12_hard_negatives, op13_merkle_manifest)}
ORACLE: dict[str, str] = {"op2_license_scan": OP2_SQL, "op5_decontaminate": OP5_SQL, "op7_warc_revisits": OP7_SQL, "op9_mix_sources": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
