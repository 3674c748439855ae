"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from lodemark.llm.decontamination import op1_decontamination
from lodemark.llm.langid import op10_langid
from lodemark.llm.linededup import OP6_SQL, op6_linededup
from lodemark.llm.packing import op5_packing
from lodemark.llm.quality import op9_quality
from lodemark.llm.quantisation import op4_quantisation
from lodemark.llm.sharding import op8_sharding
from lodemark.llm.simhash import op2_simhash
from lodemark.llm.toxicity import op3_toxicity
from lodemark.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_quantisation": op4_quantisation,
    "op5_packing": op5_packing,
    "op6_linededup": op6_linededup,
    "op7_warc": op7_warc,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_langid": op10_langid,
}
ORACLE_SQL: dict[str, str] = {"op6_linededup": OP6_SQL, "op7_warc": OP7_SQL}
