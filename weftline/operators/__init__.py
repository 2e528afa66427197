"""Relational operators; each module declares a logical plan and leaves the physical strategy to Catalyst and AQE."""
