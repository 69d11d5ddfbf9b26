"""Jobs: inputs and SQL tasks as a graph, run with validations and recorded."""

from .loader import load_job
from .model import Job, Task, Validation
from .runner import Listener, run_job

__all__ = ["Job", "Listener", "Task", "Validation", "load_job", "run_job"]
