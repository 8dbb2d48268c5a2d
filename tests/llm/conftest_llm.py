"""Names of the fixtures' helpers for tests to import."""

import importlib.util
from pathlib import Path

_spec = importlib.util.spec_from_file_location("llm_fixtures", Path(__file__).with_name("conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
make_documents, words_of, DOCUMENTS = _module.make_documents, _module.words_of, _module.DOCUMENTS
