"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import bpe, chat_format, exact_dedup, licenses, line_dedup, media, mixing, simhash, token_files, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_media": media.op2_media,
    "op3_simhash": simhash.op3_simhash,
    "op4_mixing": mixing.op4_mixing,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_bpe": bpe.op6_bpe,
    "op7_token_files": token_files.op7_token_files,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op8_chat_format": chat_format.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
