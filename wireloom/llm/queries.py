"""The queries of the operators and their SQL, by name."""

from .bpe import op13_bpe
from .chat import OP5_SQL, op5_chat
from .decontam import op8_decontaminate
from .langid import op1_langid
from .lexical import OP12_SQL, op12_search
from .mixing import op4_mixing
from .passages import op10_passages
from .quality_model import op6_quality
from .quality_rules import OP3_SQL, op3_host_rules
from .simhash import op2_simhash
from .tokens import op9_token_shards
from .toxicity import op7_toxicity
from .whitening import op11_whitening

QUERIES = {
    "op1_langid": op1_langid,
    "op2_simhash": op2_simhash,
    "op3_host_rules": op3_host_rules,
    "op4_mixing": op4_mixing,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_shards": op9_token_shards,
    "op10_passages": op10_passages,
    "op11_whitening": op11_whitening,
    "op12_search": op12_search,
    "op13_bpe": op13_bpe,
}
ORACLE_SQL = {"op3_host_rules": OP3_SQL, "op5_chat": OP5_SQL, "op12_search": OP12_SQL}
