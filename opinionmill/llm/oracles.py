"""SQL for the queries that SQL can express; the others are tested against brute force in ``tests/llm``."""

from .chat import ROTATE_SQL
from .lexical_search import SEARCH_SQL

ORACLES = {"op10_chat_formatting": ROTATE_SQL, "op12_lexical_search": SEARCH_SQL}
