from .rowid import ROW_ID, with_row_id
from .scratch import drop_scratch, freeze, scratch_root, spread

__all__ = ["ROW_ID", "drop_scratch", "freeze", "scratch_root", "spread", "with_row_id"]
