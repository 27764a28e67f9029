from acervo.sources.tables import checkpoint_dir, cut, read_table

__all__ = ["checkpoint_dir", "cut", "read_table"]
