from .bucketed import BUCKET_KEYS, save_bucketed
from .schemas import SCHEMAS
from .tables import Tables

__all__ = ["BUCKET_KEYS", "SCHEMAS", "Tables", "save_bucketed"]
