"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP10_SQL, op10_decontaminate
from .importance import OP13_SQL, op13_importance
from .langid import op8_langid
from .maintext import op9_maintext
from .mixing import op2_mixing
from .neighbours import OP7_SQL, op7_neighbours
from .passages import op1_passages
from .periodic import OP12_SQL, op12_periodic
from .quality import op4_quality
from .simhash import op3_simhash
from .tokencount import op5_tokencount
from .toolcalls import OP6_SQL, op6_toolcalls
from .warc import OP11_SQL, op11_warc

QUERIES = {
    "op1_passages": op1_passages,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_tokencount": op5_tokencount,
    "op6_toolcalls": op6_toolcalls,
    "op7_neighbours": op7_neighbours,
    "op8_langid": op8_langid,
    "op9_maintext": op9_maintext,
    "op10_decontaminate": op10_decontaminate,
    "op11_warc": op11_warc,
    "op12_periodic": op12_periodic,
    "op13_importance": op13_importance,
}
ORACLES: dict[str, str] = {
    "op6_toolcalls": OP6_SQL,
    "op7_neighbours": OP7_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_warc": OP11_SQL,
    "op12_periodic": OP12_SQL,
    "op13_importance": OP13_SQL,
}
