"""Tables written between jobs, as the whole library writes them (see ``docloom.tables``)."""

from docloom.tables import Workspace, clean, mark, shared_dir, ship, sweep

__all__ = ["Workspace", "clean", "mark", "shared_dir", "ship", "sweep"]
