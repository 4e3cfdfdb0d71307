"""Plans: the registered queries, their oracle SQL and the job orchestration."""
