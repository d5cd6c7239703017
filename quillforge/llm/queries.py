"""Queries of this subpackage by name. Only op5, op12 and op13 can be said in SQL; tests hold the others against
brute force, the tokeniser libraries, a round trip or held-out labels instead."""

from quillforge.llm.divergence import OP13_SQL, op13_divergence
from quillforge.llm.fingerprints import op11_fingerprints
from quillforge.llm.langid import op7_language
from quillforge.llm.lattice import op9_lattice
from quillforge.llm.licenses import op10_licenses
from quillforge.llm.manifest import OP12_SQL, op12_manifest
from quillforge.llm.media import op4_media
from quillforge.llm.neardup import op1_neardup
from quillforge.llm.packing import op6_packing
from quillforge.llm.pieces import op3_pieces
from quillforge.llm.search import OP5_SQL, op5_search
from quillforge.llm.secrets import op8_secrets
from quillforge.llm.substrings import op2_substrings

QUERIES = {f.__name__: f for f in (op1_neardup, op2_substrings, op3_pieces, op4_media, op5_search, op6_packing, op7_language, op8_secrets, op9_lattice, op10_licenses, op11_fingerprints, op12_manifest, op13_divergence)}
ORACLES = {"op5_search": OP5_SQL, "op12_manifest": OP12_SQL, "op13_divergence": OP13_SQL}
