"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from quarryweb.llm.decontaminate import OP6_SQL, op6_decontamination
from quarryweb.llm.fingerprint import op5_fingerprints
from quarryweb.llm.html_content import OP7_SQL, op7_html_extraction
from quarryweb.llm.jaccard import OP4_SQL, op4_ngram_jaccard_join
from quarryweb.llm.packing import op2_best_fit_packing
from quarryweb.llm.quality import op9_quality_classifier
from quarryweb.llm.secrets import OP1_SQL, op1_secret_scan
from quarryweb.llm.substring import OP8_SQL, op8_substring_dedup
from quarryweb.llm.suffix_tree import op3_lm_scoring
from quarryweb.llm.tokfile import op10_token_files

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_best_fit_packing, op3_lm_scoring, op4_ngram_jaccard_join, op5_fingerprints, op6_decontamination, op7_html_extraction, op8_substring_dedup, op9_quality_classifier, op10_token_files)}

ORACLE_SQL = {"op1_secret_scan": OP1_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op8_substring_dedup": OP8_SQL, "op6_decontamination": OP6_SQL, "op7_html_extraction": OP7_SQL}
