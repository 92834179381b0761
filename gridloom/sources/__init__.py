"""Reading and writing stacks, calendars of composite periods."""
