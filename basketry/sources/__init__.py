from .tables import concat_frames, query_view, read_orders, read_text_table, register, write_frame

__all__ = ["concat_frames", "query_view", "read_orders", "read_text_table", "register", "write_frame"]
