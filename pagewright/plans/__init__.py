from . import admission, catalog, content, forms, graph, history, layout, pages, safety  # noqa: F401
from .pages import export_manifest
from .registry import ORACLE_SQL, QUERIES
