import pytest


@pytest.fixture(scope="session")
def documents_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"
