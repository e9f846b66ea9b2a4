"""The operators' queries, each over its whole table. SQL says what op4, op7 and op10 do; for the others it
can't, or not at this size: each is tested against brute force, a round trip or held-out accuracy."""

import corpus_pipeline
from tidelog.llm import decontaminate, extract, language, neighbours, packing, repeats, secrets, sharding, simhash, tokenfiles
from tidelog.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_token_files": tokenfiles.op1,
    "op2_language_id": language.op2,
    "op3_html_extraction": extract.op3,
    "op4_decontamination": decontaminate.op4,
    "op5_suffix_dedup": repeats.op5,
    "op6_simhash_near_dedup": simhash.op6,
    "op7_secret_scan": secrets.op7,
    "op8_best_fit_packing": packing.op8,
    "op9_nearest_neighbours": neighbours.op9,
    "op10_sharding": sharding.op10,
    "langid_pages": language.langid_pages,
    "pipeline": corpus_pipeline.run,
}
