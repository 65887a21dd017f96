"""Multi-step jobs: sample building, source models, transfer and adaptation."""
