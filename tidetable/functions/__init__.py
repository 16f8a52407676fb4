from .columns import *  # noqa: F403
