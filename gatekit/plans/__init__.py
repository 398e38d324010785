from .plan import CANDIDATES, Candidate, GatePlan, GatePolicy, risk_shares

__all__ = ["CANDIDATES", "Candidate", "GatePlan", "GatePolicy", "risk_shares"]
