"""Plans: operators composed to whole jobs."""
