"""Closed vocabularies and column lists of the property graph."""

from __future__ import annotations

# Fixed values.
NODE_TYPES = "FILE MODULE CLASS FUNCTION METHOD VARIABLE IMPORT EXPORT API_ENDPOINT ROUTE_HANDLER DB_TABLE DB_QUERY EVENT DATA_KEY DOMAIN_CONCEPT".split()
EDGE_TYPES = "CONTAINS DECLARES BELONGS_TO IMPORTS IMPORTS_SYMBOL EXPORTS EXTENDS CALLS DISPATCHES INSTANTIATES REFERENCES USES ROUTES_TO TRIGGERS EMITS CONSUMES DEPENDS_ON WRITES_KEY READS_KEY DECLARES_KEY HANDLES TRANSFORMS VALIDATES AUTHORIZES PERSISTS DOMAIN_DEPENDS_ON".split()
NAMESPACES = "INTERNAL STDLIB EXTERNAL UNKNOWN".split()
STRUCTURAL = ["CONTAINS", "DECLARES"]
KEY_TYPES = ["WRITES_KEY", "READS_KEY", "DECLARES_KEY"]
BEHAVIORAL = [t for t in EDGE_TYPES if t not in STRUCTURAL + KEY_TYPES]
HEALTH_TYPES = ["CALLS", "IMPORTS", "REFERENCES", "USES"]
ENFORCEMENT = ["CALLS", "DEPENDS_ON", "AUTHORIZES"]
USE_TYPES = ["CALLS", "EXTENDS", "REFERENCES"]
EXTERNAL_PATH = "EXTERNAL"
RAW_CALL = "raw_call:"

NODE_COLUMNS = ["type", "name", "file_path", "start_line", "end_line", "language", "ontology_class", "confidence_score", "metadata", "namespace", "is_test", "is_generated", "domains"]
EDGE_COLUMNS = ["weight", "confidence", "context", "file_path", "line_number", "type_only"]
