"""Plain functions: keys, patterns, schedules and generators."""
